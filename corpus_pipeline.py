"""A training-data pipeline over ``documents``.

``STAGES`` lists the stages in order. Each function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``documents``. Between
stages the rows are written as Parquet and read again, so a lost executor repeats
one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import decontaminate, jaccard, packing, substring, toxicity
from vitrine.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (operator 1) does not reject."""
    scored = toxicity.scores(docs, C.table(spark, sf_dir, "labels"), keep=docs.columns)
    return scored.filter("score < 0.5").select("row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a long ``_key`` for each different text: its row key, but where
    one id stands for several texts a number of 2**62 and more from id and text, so that
    ids of one text come before it. Repeated rows share their key."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    rows = docs.withColumn("_key", C.row_key()).withColumn("_th", th)
    shared = (rows.groupBy("_key").agg(F.min("_th").alias("a"), F.max("_th").alias("b"))
              .filter("a <> b").select("_key", F.lit(True).alias("_shared")).checkpoint())
    if shared.isEmpty():
        return rows.drop("_th")
    own = (F.xxhash64("_key", "_th").bitwiseAND(F.lit(2 ** 62 - 1))
           .bitwiseOR(F.lit(2 ** 62)))
    return (rows.join(shared, "_key", "left")
            .withColumn("_key", F.when(F.col("_shared"), own).otherwise(F.col("_key")))
            .drop("_th", "_shared"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (operator 6) the document with the smallest
    key, which is its id where that names one text; repeated rows stay once."""
    rows = keyed(docs)
    classes = jaccard.jaccard_classes(rows.select(F.col("_key").alias("doc_id"), "text"))
    kept = classes.filter("key = class_key").select(F.col("key").alias("_key")).distinct()
    return (rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"])
            .select(*docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words and more that occur elsewhere too
    (operator 4). A text that loses nothing stays as it is, byte for byte."""
    others = [c for c in docs.columns if c != "text"]
    cut = substring.substring_dedup(docs, keep=others).select(
        "row.*", F.col("kept_text").alias("text"), "n_removed")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 2)."""
    rows = keyed(docs)
    found = decontaminate.contaminated(
        rows.select(F.col("_key").alias("doc_id"), "text"), C.table(spark, sf_dir, "benchmark"))
    bad = found.select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(bad, "_key", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences (operator 10): one row per piece."""
    return packing.harmonic_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, MinHash and tokenizer ids have no SQL form; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other; returns the pieces."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = C.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
