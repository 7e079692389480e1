"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, surrogates for personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, jaccard, langid, packing, pii
from tallyweave.llm.registry import tokenizer_path
from tallyweave.llm.runtime import materialize

#: A document whose language is less certain than this goes.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without letters and uncertain ones go."""
    model = langid.fit(docs.filter(~langid.held_out()))
    judged = langid.predict(docs, model, lang_column="__lang", score_column="__score")
    return judged.filter((F.col("__lang") != "und") & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of similar ones. Rows equal in id and text are one document, rows with one id and
    different texts are several; rows without an id link with nothing and stay."""
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    found = materialize(jaccard.jaccard_components(docs.select(key.alias("row"), "text"), key="row"), "components")
    named = docs.select("*", key.alias("__row"))
    left = named.join(found.filter("component_id < row").select(F.col("row").alias("__row")).distinct(), "__row", "left_anti")
    again = materialize(found.filter("row is not null").groupBy("row").count().filter("count > 1").select(F.col("row").alias("__row")), "again")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(again, "__row", "left_anti").select(*docs.columns)
    return once.union(left.join(again, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.filter(~decontaminate.is_contaminated(docs, items, F.col("text")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; n_chars follows the new text."""
    out = pii.replace_entities(docs, secret=pii.session_secret(spark), count_column=None)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return out if kind is None else out.withColumn("n_chars", F.length("text").cast(kind))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its bucket and batch."""
    return packing.pack(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Language models, byte-pair tokens and keyed surrogates are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
