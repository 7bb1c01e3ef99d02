"""The driver's tables seen as the engine's: orders as solutions, their lines as steps, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import numbered

RANKS = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, step_index and three flags for each line: gold (returned), arm a (discount), arm b (tax)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *_ORDER)
    out = numbered(rows.withColumnRenamed("l_orderkey", "uid"), "uid", _ORDER)
    return out.withColumns({"gold_bad": F.col("l_returnflag") == "R", "bad_a": F.col("l_discount") >= 0.08, "bad_b": F.col("l_tax") >= 0.07})


STEPS_SQL = """
s AS (SELECT l_orderkey AS uid, l_returnflag, l_quantity, l_discount, l_tax, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS step_index,
        l_returnflag = 'R' AS gold_bad, l_discount >= 0.08 AS bad_a, l_tax >= 0.07 AS bad_b FROM lineitem)"""


def first_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, gold_label, pred_a, pred_b, n_steps, steps_a, steps_b: one aggregation on the steps' own partitioning."""
    first = lambda c: F.coalesce(F.min(F.when(F.col(c), F.col("step_index"))), F.lit(-1))
    out = steps(spark, sf_dir).groupBy("uid").agg(first("gold_bad").alias("gold_label"), first("bad_a").alias("pred_a"), first("bad_b").alias("pred_b"), F.count("*").alias("n_steps"))
    read = lambda c: F.when(F.col(c) < 0, F.col("n_steps")).otherwise(F.col(c) + 1)
    return out.withColumns({"steps_a": read("pred_a"), "steps_b": read("pred_b")})


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with subset (the order's priority), status and price."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("subset"), "o_orderstatus", "o_totalprice")
    return first_flags(spark, sf_dir).join(orders, "uid")


SOLUTIONS_SQL = (
    STEPS_SQL
    + """,
f AS (SELECT uid, coalesce(min(CASE WHEN gold_bad THEN step_index END), -1) AS gold_label, coalesce(min(CASE WHEN bad_a THEN step_index END), -1) AS pred_a,
        coalesce(min(CASE WHEN bad_b THEN step_index END), -1) AS pred_b, count(*) AS n_steps FROM s GROUP BY uid),
j AS (SELECT f.*, CASE WHEN pred_a < 0 THEN n_steps ELSE pred_a + 1 END AS steps_a, CASE WHEN pred_b < 0 THEN n_steps ELSE pred_b + 1 END AS steps_b,
        o_orderpriority AS subset, o_orderstatus, o_totalprice FROM f JOIN orders ON o_orderkey = uid)"""
)


def arm(rows: DataFrame, which: str) -> DataFrame:
    """Predictions of one arm."""
    return rows.select("uid", "subset", "gold_label", F.col(f"pred_{which}").alias("predicted_label"), "n_steps", F.col(f"steps_{which}").alias("n_steps_scored"), F.lit(which).alias("arm"))


def both_arms(rows: DataFrame) -> DataFrame:
    """Predictions of both arms from one pass: a row becomes two."""
    two = F.explode(F.array(*(F.struct(F.lit(x).alias("arm"), F.col(f"pred_{x}").alias("predicted_label"), F.col(f"steps_{x}").alias("n_steps_scored")) for x in "ab")))
    return rows.select("*", two.alias("_x")).select("uid", "subset", "gold_label", "n_steps", "_x.*", "o_orderstatus", "o_totalprice")


ARMS_SQL = (
    SOLUTIONS_SQL
    + """,
r AS (SELECT uid, subset, gold_label, n_steps, 'a' AS arm, pred_a AS predicted_label, steps_a AS n_steps_scored, o_orderstatus, o_totalprice FROM j
      UNION ALL SELECT uid, subset, gold_label, n_steps, 'b', pred_b, steps_b, o_orderstatus, o_totalprice FROM j)"""
)


def severity_sql(column: str = "subset") -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in RANKS.items()) + " ELSE 99 END"


F1_SQL = "CASE WHEN ea IS NULL OR ca IS NULL THEN NULL WHEN ea <= 0 OR ca <= 0 THEN 0 ELSE 2 * ea * ca / (ea + ca) END"
