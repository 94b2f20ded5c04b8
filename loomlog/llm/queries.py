"""The queries op1 to op10 over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontaminate, embed_dedup, language_id, licences, near_dedup, packing, quality, sharding, tokenfile, url_filter
from loomlog.llm.common import Scratch, crc_mod, table


URL_RULES = (
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
)
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = language_id.fit(docs.where(crc_mod("doc_id", 5) != 0))
    return language_id.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n_words=2, percent=80)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = Scratch(spark).write(quality.document_statistics(docs), "stats")
    model = quality.fit(stats.where(crc_mod("doc_id", 3) != 1), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return quality.score(stats, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).root}/tokens"
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.digests(spark, path)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of a document is its source and, as directories of a hundred, its number."""
    number = F.col("doc_id").cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), number)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return licences.scan(docs)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_sharding, op4_minhash_near_dedup, op5_decontamination, op6_quality_classifier, op7_token_output, op8_embedding_near_dedup, op9_packing, op10_licence_scan)}
ORACLES: dict[str, str] = {"op2_url_filter": url_filter.oracle(URL_RULES), "op3_sharding": sharding.oracle(SHARDS), "op4_minhash_near_dedup": near_dedup.oracle(), "op8_embedding_near_dedup": embed_dedup.oracle()}
