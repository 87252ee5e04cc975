"""Column builders. Everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession, functions as F

from txquality import schema as S


def rounded(col: Column, digits: int) -> Column:
    """Round by scaling, which gives the same double in Spark and in other SQL engines."""
    factor = F.lit(float(10**digits))
    return F.round(col * factor) / factor


def hour_of_day(time: Column) -> Column:
    return F.floor((time % F.lit(S.SECONDS_PER_DAY)) / F.lit(3600.0)).cast("int")


def log_amount(amount: Column) -> Column:
    return F.ln(amount + F.lit(1))


def amount_bucket(amount: Column) -> Column:
    expr = F.when(amount == 0, F.lit("zero"))
    for name, limit in S.BUCKET_LIMITS.items():
        expr = expr.when(amount < limit, F.lit(name))
    return expr.otherwise(F.lit("very_high"))


def clock_label(time: Column) -> Column:
    """Dataset clock, e.g. ``J2 03:04:05``."""
    day = F.floor(time / F.lit(float(S.SECONDS_PER_DAY))) + 1
    rest = F.floor(time % F.lit(S.SECONDS_PER_DAY)).cast("long")
    return F.format_string(
        "J%d %02d:%02d:%02d", day, F.floor(rest / 3600), F.floor((rest % 3600) / 60), rest % 60
    )


def transaction_label(row_id: Column) -> Column:
    return F.format_string("TX-%06d", row_id)


def short_hash(value: Column) -> Column:
    return F.coalesce(F.substring(value, 1, 8), F.lit("—"))


def day_range(time: Column, first_day: int | None, last_day: int | None) -> Column:
    """Rows of the given days. The upper edge is a whole second, so a fractional last second is left out."""
    expr = F.lit(True)
    if first_day is not None:
        expr = expr & (time >= F.lit(float((first_day - 1) * S.SECONDS_PER_DAY)))
    if last_day is not None:
        expr = expr & (time <= F.lit(float(last_day * S.SECONDS_PER_DAY - 1)))
    return expr


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp as displayed, whatever the session time zone."""
    instant = F.unix_micros(ts.cast("timestamp"))
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"):
        return instant
    day = F.unix_date(ts.cast("date")).cast("long") * F.lit(86_400)
    second = (F.hour(ts) * 60 + F.minute(ts)) * 60 + F.second(ts)
    return (day + second) * F.lit(1_000_000) + F.pmod(instant, F.lit(1_000_000))


def hashed(digits: int, *parts: Column | str | int) -> Column:
    """Number from the first hexadecimal digits of md5 over the parts joined with ``:``; depends on the parts alone."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def hash32(*parts: Column | str | int) -> Column:
    return hashed(8, *parts)


def uniform(*parts: Column | str | int) -> Column:
    """Uniform number in (0, 1) with 52 random bits."""
    return (hashed(13, *parts).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def standard_normal(*parts: Column | str | int) -> Column:
    """Standard normal number (Box-Muller) from two hash uniforms."""
    u1 = uniform(*parts, "a")
    u2 = uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def plural_part(count: Column, label: str) -> Column:
    """``1 row created`` / ``2 rows created``; NULL for zero so that concat_ws leaves it out."""
    return F.when(
        count > 0, F.concat(count.cast("string"), F.when(count > 1, F.lit(" rows ")).otherwise(F.lit(" row ")), F.lit(label))
    )


def psi_level(psi: Column) -> Column:
    return (
        F.when(psi < S.PSI_MODERATE, F.lit("green")).when(psi < S.PSI_HIGH, F.lit("orange")).otherwise(F.lit("red"))
    )


def psi_verdict(psi: Column) -> Column:
    level = psi_level(psi)
    expr = F.when(level == "green", F.lit(S.PSI_VERDICTS["green"]))
    expr = expr.when(level == "orange", F.lit(S.PSI_VERDICTS["orange"]))
    return expr.otherwise(F.lit(S.PSI_VERDICTS["red"]))
