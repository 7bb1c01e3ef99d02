"""Which benchmark problems the retrieval pool already holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_question


def verbatim(problems: DataFrame, pool: DataFrame, problem: str = "problem", question: str = "question", unicode: bool = True) -> DataFrame:
    """Problems whose normalised text equals a pool question's: a semi-join on the normalised text."""
    keys = pool.select(normalise_question(question, unicode).alias("_key")).distinct()
    return problems.withColumn("_key", normalise_question(problem, unicode)).join(keys, "_key", "left_semi").drop("_key")


def nearest(problems: DataFrame, questions: DataFrame) -> DataFrame:
    """(uid, max_similarity) of each problem over all pool questions; vectors of unit length."""
    from .retrieve import topk_by_cosine

    best = topk_by_cosine(problems.select(F.col("uid").alias("query_id"), "vec"), questions.select(F.col("qid").alias("item_id"), "vec"), 1)
    return best.select(F.col("query_id").alias("uid"), F.col("similarity").alias("max_similarity"))


def flags(problems: DataFrame, verbatim_uids: DataFrame, similarities: DataFrame | None = None, threshold: float = 0.95) -> DataFrame:
    """Per problem: verbatim, near_duplicate (null if similarities were skipped), max_similarity, flagged."""
    out = problems.join(verbatim_uids.select("uid", F.lit(True).alias("_v")).distinct(), "uid", "left").withColumn("verbatim", F.coalesce("_v", F.lit(False))).drop("_v")
    if similarities is None:
        out = out.withColumns({"max_similarity": F.lit(None).cast("double"), "near_duplicate": F.lit(None).cast("boolean")})
    else:
        out = out.join(similarities, "uid", "left").withColumn("near_duplicate", F.coalesce(F.col("max_similarity") >= threshold, F.lit(False)))
    return out.withColumn("flagged", F.col("verbatim") | F.coalesce("near_duplicate", F.lit(False)))


def report(flagged: DataFrame, subset: str = "subset") -> DataFrame:
    """n, verbatim, its percentage and near duplicates for each subset and TOTAL, from one rollup."""
    out = flagged.rollup(subset).agg(F.grouping(subset).alias("_all"), F.count("*").alias("n"), F.count_if("verbatim").alias("verbatim"), F.when(F.count("near_duplicate") > 0, F.count_if("near_duplicate")).alias("near_duplicate"))
    return out.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(subset)).alias(subset), "n", "verbatim", F.round(100.0 * F.col("verbatim") / F.col("n"), 1).alias("verbatim_pct"), "near_duplicate")


def containment(texts: DataFrame, items: DataFrame, text_id: str, text: str, item_id: str, item: str) -> DataFrame:
    """(text_id, item_id) of items that occur verbatim inside a text.

    All but the first and last word of an item are whole words of a text that contains it, so an item is
    only compared with texts that have its rarest inner word (by the number of texts). Items of one word
    lie inside a word of the text, items of two at the end of one and the start of the next: they meet the
    pieces of that length of the texts' distinct words, by equality.
    """
    split = lambda c: F.split(c, r"\s+")
    own = items.select(F.col(item_id), F.col(item).alias("_item")).where("_item IS NOT NULL AND _item <> ''")
    inner = own.withColumn("_inner", F.slice(split(F.col("_item")), F.lit(2), F.greatest(F.size(split(F.col("_item"))) - 2, F.lit(0))))
    words = inner.select(item_id, F.explode(F.array_distinct("_inner")).alias("_word"))
    met = texts.select(text_id, F.explode(F.array_distinct(split(F.col(text)))).alias("_word")).join(words.select("_word").distinct(), "_word", "left_semi")
    df = met.groupBy("_word").agg(F.count("*").alias("_df"))
    keys = words.join(df, "_word").groupBy(item_id).agg(F.min_by("_word", F.struct("_df", "_word")).alias("_word"))
    pairs = met.join(keys, "_word").select(text_id, item_id).distinct()
    hits = pairs.join(own, item_id).join(texts.select(text_id, text), text_id).where(F.contains(F.col(text), F.col("_item"))).select(text_id, item_id)
    short = inner.where(F.size("_inner") == 0).select(item_id, "_item")
    keyed = short.withColumns({"_words": split(F.col("_item"))}).withColumns({"_first": F.col("_words")[0], "_last": F.col("_words")[F.size("_words") - 1]})
    side = F.when(F.size("_words") == 1, "inside").when(F.length("_first") >= F.length("_last"), "end").otherwise("start")
    keyed = keyed.select(item_id, "_item", side.alias("_side"), F.when(F.length("_first") >= F.length("_last"), F.col("_first")).otherwise(F.col("_last")).alias("_key"))
    lengths = {"inside": [], "end": [], "start": []}
    for r in keyed.select("_side", F.length("_key").alias("n")).distinct().collect():  # at most three for each length of a word
        lengths[r["_side"]].append(r["n"])
    if not any(lengths.values()):
        return hits.distinct()
    listed = texts.select(text_id, F.explode(F.array_distinct(split(F.col(text)))).alias("_word"))
    size = F.length("_word")

    def pieces(side: str):
        """The pieces of a word that a key of this side can equal."""
        fitting = F.filter(F.lit(lengths[side]).cast("array<int>"), lambda n: n <= size)
        if side == "inside":
            return F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr("_word", i, n))))
        return F.transform(fitting, lambda n: F.substr("_word", F.lit(1) if side == "start" else size - n + 1, n))

    def named(side: str):
        return F.transform(F.array_distinct(pieces(side)), lambda x: F.struct(F.lit(side).alias("_side"), x.alias("_key")))

    each = [named(s) for s in lengths if lengths[s]]
    found = listed.select("_word").distinct().select("_word", F.explode(F.concat(*each)).alias("_p")).select("_word", "_p.*")
    near = listed.join(found.join(keyed, ["_side", "_key"]), "_word").select(text_id, item_id, "_item").distinct()
    few = near.join(texts.select(text_id, text), text_id).where(F.contains(F.col(text), F.col("_item"))).select(text_id, item_id)
    return hits.union(few).distinct()
