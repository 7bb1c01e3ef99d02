"""A corpus pipeline over ``documents``: language ID, near-duplicate removal, benchmark decontamination,
redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but
the last return the columns of ``documents``. Documents with a null doc_id pass the filters on their own
merits; they are never taken for copies of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch, table
from gradeloom.llm.decontaminate import match_benchmark
from gradeloom.llm.jaccard_join import jaccard_components
from gradeloom.llm.language_id import identify, learn, learnable
from gradeloom.llm.packing import pack
from gradeloom.llm.pii import learn as learn_pii
from gradeloom.llm.pii import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: no SQL: four of the stages are not expressible in it
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identifier doesn't reject."""
    docs = docs.select(COLUMNS)
    return identify(docs, learn(learnable(docs)), COLUMNS).where("not rejected").select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id.

    Rows that repeat a doc_id are compared each for itself, under a hash of id and text in place of the id.
    """
    docs = docs.select(COLUMNS)
    repeated = Scratch(spark, "pipeline").save(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        keyed = docs.withColumn("_key", F.col("doc_id"))
    else:
        keyed = docs.join(repeated.withColumn("_again", F.lit(True)), "doc_id", "left").withColumn("_key", F.when(F.col("_again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    found = Scratch(spark, "pipeline").save(jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text")), "components")
    firsts = found.where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    out = keyed.join(firsts, "_key", "left_semi")
    if not repeated.isEmpty():  # rows of the same id and text
        one = Window.partitionBy("_key").orderBy("lang", "source", "n_chars")
        out = out.withColumn("_row", F.row_number().over(one)).where("_row = 1")
    return out.select(COLUMNS).union(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_key"))
    found = match_benchmark(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    docs = docs.select(COLUMNS)
    return redact(docs, learn_pii(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row for each piece."""
    return pack(docs, word_cache=300_000)  # its workers also hold what the stages before have left


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
