"""Named queries of this subpackage, with production parameters, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txquality.llm.common import id_remainder, table
from txquality.llm.sql import MERKLE


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import warc

    captures = warc.archive(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "range", "place")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import line_dedup

    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_chars", "removed_chunks", "removed_chars")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import language_id

    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(3) == 1
    model = language_id.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return language_id.predict(docs, model, held_out)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import url_filter

    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import toxicity

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.classify(table(spark, sf_dir, "documents"), labels, F.coalesce(id_remainder(5) == 0, F.lit(False)))


def op4_tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import tree_forest

    return tree_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import jaccard_join

    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, F.coalesce(id_remainder(4) == 2, F.lit(False)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import decontaminate

    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txquality.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents whose id has a crc32 that ten divides, the words from some place on are repeated periodically first."""
    from txquality.llm import word_runs

    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    first = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - first) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - first) / period).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, first + 1, period), times)), F.lit(1), n - first)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), first), repeated), " ")
    found = word_runs.find_runs(docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases the letters A to Z of texts whose id has a crc32 that 5 divides."""
    from txquality.llm import merkle

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = merkle.manifest(table(spark, sf_dir, "documents"), F.when(id_remainder(5) == 0, lowered))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op9_url_filter": op9_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_tree_forest": op4_tree_forest,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_word_runs": op12_word_runs,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {"op13_merkle": MERKLE}
