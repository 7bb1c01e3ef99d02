"""Operator 13: audit of how filters interact, by inclusion-exclusion over joint failures.

Five filters give five failure flags for each document. For each of the 32 sets S of filters one sum over the
product of S's flags counts the documents that fail all of S (the joint failures F(S)), once for all documents
of a part and once each for those that carry a mark. Everything else follows from these 32 numbers a part,
without another look at a document, in whatever order the filters are applied:

* survivors of a set P: the sum of (-1)^|S| F(S) over the subsets S of P (Moebius inversion); what a step
  removes is the difference of the survivors before and after it;
* redundant: F({f}) without what the step removes;
* unique failures of f: the sum of (-1)^|T| F(T + f) over the sets T of other filters;
* the Shapley value of f: each set S has the Harsanyi dividend (-1)^(|S|+1) F(S), which its members share
  evenly. 120 times the value is whole, since 1 to 5 divide 120.

Which document repeats another's text: the smallest id of each text's digest comes from a minimum (made from
partial ones), and a row is a first one if (digest, id) is among these minima. So the hot text is never a join
key: both joins go by doc_id. All is declared with DataFrame functions; text is read once and only flags, ids
and digests are shuffled.

Defined cases: a null text is empty; a null source is the part of the empty string, with the sources that are
empty; a null doc_id is not comparable, so that it neither has nor is a smaller id; rows that repeat an id and
a text are all first ones, if no smaller id has the text; a document has a mark if any row of ``labels`` of
its id says so; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

FILTERS = "ABCDE"
SPACE = "\\x20\\x09-\\x0D"


def text_flags(text: str = "text") -> dict[str, Column]:
    """The filters that look at a text alone: too few words, words that repeat, shouting, symbols."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, f"[{SPACE}]+"), "")
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {"_words": words, "A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length(t), "D": t.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each row of ``docs(doc_id, text, source)``, as booleans."""
    flags = text_flags()
    words = flags.pop("_words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("_words", words).withColumns(flags).withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    rows = scratch.save(rows.select("doc_id", "part", "digest", *flags), "flags")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    # null ids match nothing: they need no join, and would meet in one task
    known = rows.where("doc_id is not null").join(first, ["doc_id", "digest"], "left").withColumn("E", F.col("_first").isNull()).join(marks, "doc_id", "left")
    other = rows.where("doc_id is null").withColumns({"E": F.lit(False), "good": F.lit(False), "toxic": F.lit(False)})
    no = F.lit(False)
    columns = ["part", *FILTERS, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")]
    return known.select(*columns).union(other.select(*columns))


def joint_failures(rows: DataFrame, filters: str = FILTERS, marks: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """For each part: ``all`` and one column a mark, arrays of the documents that fail every filter of set S, at place S (bit i: filter i)."""
    sets = range(1 << len(filters))

    def product(subset: int, mark: str) -> str:
        return " * ".join(["1L", *([] if mark == "all" else [f"int({mark})"]), *(f"int({f})" for i, f in enumerate(filters) if subset >> i & 1)])

    out = rows.groupBy("part").agg(*(F.expr(f"sum({product(s, m)})").alias(f"_{m}{s}") for m in ("all", *marks) for s in sets))
    return out.select("part", *(_array([f"_{m}{s}" for s in sets]).alias(m) for m in ("all", *marks)))


def _signed(joint: str, sets: list[tuple[int, int]]) -> str:
    """The sum of weight times F(S) over (S, weight), as an expression."""
    return " + ".join(f"{weight} * {joint}[{s}]" for s, weight in sets)


def _array(sums: list[str]) -> Column:
    return F.expr(f"array({', '.join(sums)})")


def survivors(joint: str, n: int) -> Column:
    """An array of what is left of a part once the filters of set P have been applied, at place P."""
    return _array([_signed(joint, [(s, (-1) ** s.bit_count()) for s in range(p + 1) if s & p == s]) for p in range(1 << n)])


def unique_failures(joint: str, n: int) -> Column:
    """An array of what fails filter i and no other."""
    return _array([_signed(joint, [(s, (-1) ** (s.bit_count() - 1)) for s in range(1 << n) if s >> i & 1]) for i in range(n)])


def shapley(joint: str, n: int, whole: int) -> Column:
    """An array of ``whole`` times the Shapley value of filter i: its shares of the dividends of the sets it is in."""
    return _array([_signed(joint, [(s, (-1) ** (s.bit_count() + 1) * whole // s.bit_count()) for s in range(1 << n) if s >> i & 1]) for i in range(n)])


def audit(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The ledger of every order of the filters, from ``joint_failures``: a row for each part, order and step."""
    n = len(filters)
    orders = ["".join(o) for o in permutations(filters)]
    sums = joint.select("part", "all", survivors("all", n).alias("left"), survivors("good", n).alias("good"), survivors("toxic", n).alias("toxic"), unique_failures("all", n).alias("unique"), shapley("all", n, len(orders)).alias("share"))
    listed = ", ".join(f"named_struct('filter_order', '{o}', 'step', {k + 1}, 'before', {sum(1 << filters.index(f) for f in o[:k])}, 'f', {filters.index(o[k])})" for o in orders for k in range(n))
    rows = sums.select("*", F.expr(f"inline(array({listed}))"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("f"))
    after = F.col("before").bitwiseOR(bit)
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    return rows.select(
        "part", "filter_order", "step", F.get("left", after).alias("kept"), lost("left").alias("removed"), (F.get("all", bit) - lost("left")).alias("redundant"),
        F.get("unique", F.col("f")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("share", F.col("f")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "audit"))
    return audit(joint_failures(rows))


OP13_SQL = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS m FROM w GROUP BY t),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
      coalesce(w.doc_id > m, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
cell AS (SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT part, filter_order, step, o[step] AS f, n, good, toxic, fails[o[step]] AS own, len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS failed FROM cell, s),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT own THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND own THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND own THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND own AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND own AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
