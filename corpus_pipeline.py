"""The corpus pipeline: quality, language, near duplicates, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
rereads it as the next one's docs. All stages but the last return the columns of documents. Null and empty texts: quality scores
them like any text, language ID rejects them as they have no letter. Stages decide by row, so that rows without a doc_id, or that repeat
one, are judged like all others; to near duplicates, rows that differ are documents of their own, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontaminate, language_id, near_dedup, packing, quality
from loomlog.llm.common import Scratch, scratch_of, table

#: Documents with a lower quality score go.
QUALITY = 0.5
#: A document goes if it has no letter, or if its text is another language than it says with this score at least.
LANGUAGE = 0.9


def _rows(docs: DataFrame, *more) -> DataFrame:
    """Each row as one column, so that no name of it clashes with a result, its text, and more."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", *more)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score, learned from labels, is at least QUALITY."""
    stats = Scratch(spark).write(quality.document_statistics(_rows(docs, "doc_id"), ("row", "doc_id")), "stats")
    model = quality.fit(stats.select("doc_id", "stats"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(stats, model, ("row",)).where(F.col("score") >= QUALITY).select("row.*")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are plainly another language than lang says; without a lang, or with one that was not learned, any language will do."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    named = language_id.predict(_rows(docs), model, ("row",))
    wrong = (F.col("lang_pred") == language_id.UND) | F.coalesce(F.col("row.lang").isin(list(model.languages)) & (F.col("lang_pred") != F.col("row.lang")) & (F.col("score") >= LANGUAGE), F.lit(False))
    return named.where(~wrong).select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 0.8 or more on five-word shingles join: that with the smallest doc_id.

    Rows without a doc_id, and all but one of those that repeat one, go by a number from the hash of the whole row, over all ids:
    each text of an id is a document, and of equal rows one stays.
    """
    name, whole = "__doc", F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    own = F.xxhash64(whole).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    rows = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), own))
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    if not repeated.isEmpty():
        again = rows.join(repeated, "doc_id", "left_semi").withColumn(name, own)
        first = again.groupBy("doc_id").agg(F.min(name).alias("__first"))
        again = again.join(first, "doc_id").withColumn(name, F.when(F.col(name) == F.col("__first"), F.col("doc_id")).otherwise(F.col(name))).select(rows.columns)
        rows = rows.join(repeated, "doc_id", "left_anti").select(rows.columns).unionByName(again)
    if not repeated.isEmpty() or not docs.where("doc_id is null").isEmpty():
        rows = Scratch(spark).write(rows.dropDuplicates([name]), "rows")
    groups = near_dedup.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"), n_words=5, percent=80)
    kept = groups.where("kept").select(F.col("doc_id").alias(name))
    return rows.join(kept, name, "left_semi").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", by_quality),
    ("language_id", by_language),
    ("minhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]
#: Learned models and approximate search decide, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch_of(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
