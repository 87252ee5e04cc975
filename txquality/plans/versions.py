"""Change batches, dataset versions and roll-back.

A version is an immutable Parquet folder plus one row in a manifest. Data is written first and the manifest row last,
so a failed job leaves the published versions as they were. One publisher at a time is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txquality import schema as S
from txquality.functions import columns as C
from txquality.operators import ranks, sequences
from txquality.session import checkpointed
from txquality.sources import files

RANGE_KEYS = 16_384
BROADCAST_RANGES = 500_000  # numbers of eight bytes


class Refused(RuntimeError):
    """A batch was refused as a whole. ``reason``: ``epoch`` (the data changed meanwhile) or ``ids`` (unknown rows, in ``ids``)."""

    def __init__(self, reason: str, message: str, ids: DataFrame | None = None):
        super().__init__(message)
        self.reason, self.ids = reason, ids


# ---- change batches -------------------------------------------------------------------------------------------------


def unknown_ids(row_count: int, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """Ids outside 0..row_count-1, NULL among them. Ids are dense, so a comparison finds them and no join is needed."""
    ids = updates.select("id").unionByName(deletes.select("id"))
    return ids.filter(F.col("id").isNull() | (F.col("id") < 0) | (F.col("id") >= row_count)).distinct()


def folded_updates(updates: DataFrame, fields: list[str], pos: str = "pos") -> DataFrame:
    """One row per id: the last value given for every field, in batch order; NULL means unchanged."""
    return updates.groupBy("id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(pos))).alias(f"_new_{f}") for f in fields]
    )


def changed_rows(base: DataFrame, updates: DataFrame, deletes: DataFrame, fields: list[str]) -> DataFrame:
    """Base rows without the deleted ones, with updates applied. Both joins use the id, so rows are shuffled once."""
    folded = folded_updates(updates, fields)
    kept = base.join(deletes.select("id").distinct(), "id", "left_anti").join(folded, "id", "left")
    return kept.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def apply_changes(base: DataFrame, updates: DataFrame, deletes: DataFrame, creates: DataFrame, fields: list[str]) -> DataFrame:
    """Rows after the batch, ids dense again: surviving rows keep their order, created rows follow in batch order."""
    rows = base.count()
    gone = deletes.select("id").distinct()
    survivors = rows - gone.count()
    kept = ranks.close_gaps(changed_rows(base, updates, deletes, fields), gone, "id", "new_id", rows)
    added = ranks.dense_index(creates, "pos", "new_id").withColumn("new_id", F.col("new_id") + F.lit(survivors))
    columns = [c for c in base.columns if c != "id"]
    renumbered = [F.col("new_id").alias("id"), *columns]
    return kept.select(*renumbered).unionByName(added.select(*renumbered), allowMissingColumns=True)


def change_counts(updates: DataFrame, deletes: DataFrame, creates: DataFrame) -> DataFrame:
    """Rows created, updated and deleted, with the summary text. Updates of deleted rows do not count."""
    distinct_deletes = deletes.select("id").distinct()
    kinds = (
        creates.select(F.lit("c").alias("kind"))
        .unionByName(updates.select("id").join(distinct_deletes, "id", "left_anti").select(F.lit("u").alias("kind")))
        .unionByName(distinct_deletes.select(F.lit("d").alias("kind")))
    )
    counts = kinds.agg(
        F.count_if(F.col("kind") == "c").alias("rows_created"),
        F.count_if(F.col("kind") == "u").alias("rows_updated"),
        F.count_if(F.col("kind") == "d").alias("rows_deleted"),
    )
    return counts.withColumn("message", correction_message())


def correction_message() -> Column:
    return F.concat_ws(
        ", ",
        C.plural_part(F.col("rows_created"), "created"),
        C.plural_part(F.col("rows_updated"), "updated"),
        C.plural_part(F.col("rows_deleted"), "deleted"),
    )


def staged_count(updates: DataFrame, deletes: DataFrame, creates: DataFrame) -> DataFrame:
    """Effective number of staged changes: a row edited several times, or edited and deleted, counts once."""
    touched = updates.select("id").unionByName(deletes.select("id")).distinct()
    every = touched.unionByName(creates.select(F.lit(None).cast("long").alias("id")))
    return every.agg(F.count(F.lit(1)).alias("staged_changes"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): names of the fields that differ, for rows present on both sides with a difference."""
    right = after.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_r_{f}")), F.lit(f)) for f in fields]))
    return before.join(right, key).select(key, names.alias("changed")).filter(F.size("changed") > 0)


def _key_range(df: DataFrame, key: str, width: int) -> Column:
    """Number of the range of keys: ``width`` whole numbers, or for other types one of 65,536 ranges of the key's hash."""
    if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        return F.floor(F.col(key) / F.lit(width)).cast("long")
    return F.when(F.col(key).isNotNull(), F.shiftrightunsigned(F.xxhash64(key), 48))


def range_digests(df: DataFrame, key: str, columns: list[str], width: int = RANGE_KEYS) -> DataFrame:
    """(key_range, digest): rows per range of keys with the exclusive or and the sum of their 64-bit marks.

    Does not depend on the order of rows; rows that repeat a key count. NULL and its place enter a mark. One small row per range
    and task is shuffled.
    """
    mark = F.xxhash64(key, *columns, *[F.col(c).isNull() for c in columns])
    marked = df.select(_key_range(df, key, width).alias("key_range"), mark.alias("_mark"))
    digest = F.struct(
        F.count(F.lit(1)).alias("row_count"), F.bit_xor("_mark").alias("marks_xor"), F.sum(F.col("_mark").cast("decimal(20,0)")).alias("marks_sum")
    )
    return marked.groupBy("key_range").agg(digest.alias("digest"))


def differing_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key_range) of two ``range_digests`` that are not equal. The range of NULL keys always counts, as NULL equals nothing."""
    other = after.select(F.col("key_range").alias("_range"), F.col("digest").alias("_digest"))
    both = before.join(other, F.col("key_range").eqNullSafe(F.col("_range")), "full_outer")
    null_range = F.col("key_range").isNull() & F.col("_range").isNull()
    differs = ~F.col("digest").eqNullSafe(F.col("_digest")) | null_range
    return both.filter(differs).select(F.coalesce("key_range", "_range").alias("key_range"))


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str], width: int = RANGE_KEYS) -> DataFrame:
    """(key, change) with change in added, removed, changed; equal rows are left out.

    Digests per range of keys are compared first; only rows of ranges that differ are joined. Their list is broadcast if it has
    ``BROADCAST_RANGES`` numbers at most, beyond that it is joined. Two different ranges pass for equal only if count, exclusive or
    and sum of their 64-bit marks all agree.
    """
    wrong = checkpointed(differing_ranges(range_digests(before, key, columns, width), range_digests(after, key, columns, width)))
    listed = F.broadcast(wrong) if wrong.count() <= BROADCAST_RANGES else wrong

    def suspect(df: DataFrame) -> DataFrame:
        return df.withColumn("_of", _key_range(df, key, width)).join(listed, F.col("_of").eqNullSafe(F.col("key_range")), "left_semi")

    left = suspect(before.select(key, *columns)).select(key, F.struct(*columns).alias("_l"))
    right = suspect(after.select(key, *columns)).select(key, F.struct(*columns).alias("_r"))
    change = (
        F.when(F.col("_l").isNull(), F.lit("added"))
        .when(F.col("_r").isNull(), F.lit("removed"))
        .when(~F.col("_l").eqNullSafe(F.col("_r")), F.lit("changed"))
    )
    return left.join(right, key, "full_outer").select(key, change.alias("change")).filter(F.col("change").isNotNull())


# ---- version history ------------------------------------------------------------------------------------------------


def version_list(commits: DataFrame, recorded: DataFrame, pos: str) -> DataFrame:
    """Commit log with recorded metadata; missing parts are read from the subject."""
    last = sequences.latest_per_key(recorded.filter(F.col("commit_sha").isNotNull()), ["commit_sha"], pos).drop(pos)
    parsed = F.nullif(F.regexp_extract("subject", S.ROWS_PATTERN, 1), F.lit("")).cast("long")
    return commits.join(last, "commit_sha", "left").select(
        "commit_sha",
        "timestamp",
        "author",
        "user",
        F.coalesce(F.col("rows_changed"), parsed).alias("rows_changed"),
        "rows_total",
        F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("subject")).alias("summary"),
        "kind",
    )


def known_version(versions: DataFrame, prefix: str) -> DataFrame:
    """Versions whose hash starts with the prefix; the prefix must be 7 to 40 hexadecimal digits."""
    is_hash = F.lit(prefix).rlike(S.VERSION_PATTERN)
    return versions.filter(is_hash & F.col("commit_sha").startswith(prefix))


# ---- snapshots ------------------------------------------------------------------------------------------------------

_MANIFEST = (
    "version long, snapshot long, epoch long, kind string, user string, rows_changed long, rows_total long, "
    "checksum string, summary string, batch string"
)


@dataclass(frozen=True)
class Snapshots:
    """Versions of one dataset under a folder: ``version=N`` data folders and a ``manifest`` of one row per version."""

    spark: SparkSession
    root: str

    def manifest(self) -> DataFrame:
        return files.read_or_empty(self.spark, "parquet", f"{self.root}/manifest", _MANIFEST)

    def current(self):
        """Newest manifest row or None."""
        row = self.manifest().agg(F.max_by(F.struct("*"), F.col("version")).alias("m")).first()
        return row["m"]

    def _append(self, **values) -> int:
        columns = [c.split()[0] for c in _MANIFEST.split(", ")]
        line = self.spark.createDataFrame([tuple(values[c] for c in columns)], _MANIFEST)
        line.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return values["version"]

    def publish(
        self, df: DataFrame, kind: str, user: str | None = None, rows_changed: int | None = None, summary: str | None = None,
        bump_epoch: bool = False, batch: str | None = None,
    ) -> int:
        """Write a snapshot, then its manifest row; returns the version number.

        ``batch`` names what the version was made for: published again, it gives the version that is there.
        """
        if batch is not None:
            there = self.manifest().filter(F.col("batch") == batch).agg(F.max("version")).first()[0]
            if there is not None:
                return there
        last = self.current()
        version = last["version"] + 1 if last else 1
        epoch = (last["epoch"] if last else 0) + int(bump_epoch)
        path = f"{self.root}/version={version}"
        df.write.mode("errorifexists").parquet(path)
        mark = files.checksum(self.spark.read.parquet(path), sorted(df.columns)).first()
        return self._append(
            version=version,
            snapshot=version,
            epoch=epoch,
            kind=kind,
            user=user,
            rows_changed=rows_changed,
            rows_total=mark["row_count"],
            checksum=f"{mark['digest_xor']}-{mark['digest_sum']}",
            summary=summary,
            batch=batch,
        )

    def read(self, version: int | None = None) -> DataFrame:
        """Rows as of a version (the newest by default)."""
        if version is None:
            row = self.current()
        else:
            row = self.manifest().filter(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"no version {version}")
        return self.spark.read.parquet(f"{self.root}/version={row['snapshot']}")

    def correct(
        self, base_epoch: int, updates: DataFrame, deletes: DataFrame, creates: DataFrame, fields: list[str], user: str | None = None
    ) -> dict:
        """Apply a change batch as a new version, or refuse it as a whole."""
        last = self.current()
        if last is None or last["epoch"] != base_epoch:
            raise Refused("epoch", "another batch was applied since the rows were read")
        wrong = unknown_ids(last["rows_total"], updates, deletes)
        found = wrong.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
        if found[0]:
            raise Refused("ids", f"{found[0]} unknown ids (missing ones included), from {found[1]} to {found[2]}", wrong)
        counts = change_counts(updates, deletes, creates).first().asDict()
        changed = counts["rows_created"] + counts["rows_updated"] + counts["rows_deleted"]
        after = apply_changes(self.read(), updates, deletes, creates, fields)
        version = self.publish(after, "dashboard_edit", user, changed, counts["message"], bump_epoch=True)
        return {**counts, "version": version}

    def roll_back(self, version: int, user: str | None = None, pending: DataFrame | None = None, pending_rows: int = 0) -> int:
        """Make an old version current as a new version; rows still pending are versioned first."""
        target = self.manifest().filter(F.col("version") == version).first()
        if target is None:
            raise ValueError(f"no version {version}")
        if pending is not None and pending_rows > 0:
            merged = self.read().unionByName(pending, allowMissingColumns=True)
            self.publish(merged, "pre_rollback", user, pending_rows, f"data: +{pending_rows} transactions")
        last = self.current()
        return self._append(
            version=last["version"] + 1,
            snapshot=target["snapshot"],
            epoch=last["epoch"] + 1,
            kind="rollback",
            user=user,
            rows_changed=None,
            rows_total=target["rows_total"],
            checksum=target["checksum"],
            summary=f"rollback to version {version}",
            batch=None,
        )


