"""Queries over the embeddings as question and step vectors, and over documents as a pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, hash_bucket, hash_tokens, l2_normalise
from ..operators import contamination, encode, retrieve
from ..operators.sequences import gapless
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", l2_normalise("embedding").alias("vec"))


_UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 1e-12)) AS vec FROM embeddings)"
_PAIRS_SQL = _UNIT_SQL + ", p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_dot_product(q.vec, i.vec) AS sim FROM u q, u i)"


@query("WITH " + _PAIRS_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, item_id) AS rank FROM p WHERE item_id <> query_id AND sim < 0.95) SELECT query_id, item_id, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS similarity FROM k WHERE rank <= 8")
def cosine_topk_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest other vectors of each vector that are not near-duplicates."""
    u = _unit(spark, sf_dir)
    out = retrieve.topk_by_cosine(u.select(F.col("vec_id").alias("query_id"), "vec"), u.select(F.col("vec_id").alias("item_id"), "vec"), 8, below=0.95, drop_same=True)
    return out.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _questions(u: DataFrame) -> DataFrame:
    """One question vector for each label: that of its smallest vec_id."""
    return u.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec"))


_TWO_SQL = _UNIT_SQL + """, qv AS (SELECT label, arg_min(vec, vec_id) AS vec FROM u GROUP BY label),
q1 AS (SELECT u.vec_id, qv.label AS qid, list_dot_product(u.vec, qv.vec) AS qs FROM u, qv),
q2 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(qs, 9) DESC, qid) AS r FROM q1 WHERE qs < 0.95),
c AS (SELECT q2.vec_id, q2.qid, qs, i.vec_id AS item_id, list_dot_product(u.vec, i.vec) AS ss FROM q2 JOIN u ON u.vec_id = q2.vec_id JOIN u i ON i.label = q2.qid WHERE r <= 3)"""


def _stage_one(u: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept = retrieve.topk_by_cosine(u.select(F.col("vec_id").alias("query_id"), "vec"), _questions(u).select(F.col("label").alias("item_id"), "vec"), 3, below=0.95)
    kept = kept.select("query_id", F.col("item_id").alias("qid"), F.col("similarity").alias("question_similarity"))
    items = u.select(F.col("vec_id").alias("item_id"), F.col("label").alias("qid"), "vec")
    return kept, items, u.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("step_index"), "vec")


def _references(df: DataFrame) -> DataFrame:
    return df.select("query_id", "qid", "item_id", F.round("question_similarity", 6).alias("question_similarity"), F.round("step_similarity", 6).alias("step_similarity"), F.col("ref_rank").cast("long").alias("ref_rank"))


_REF_SQL = " SELECT vec_id AS query_id, qid, item_id, round(qs, 6) AS question_similarity, round(ss, 6) AS step_similarity, CAST(rank AS BIGINT) AS ref_rank FROM k WHERE rank <= 2"


@query("WITH " + _TWO_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(ss, 9) DESC, item_id) AS rank FROM c)" + _REF_SQL)
def two_stage_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions, then the two most similar of their steps."""
    kept, items, own = _stage_one(_unit(spark, sf_dir))
    return _references(retrieve.retrieve_steps(kept, items, own, 2))


@query("WITH " + _TWO_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(qs, 9) DESC, round(ss, 9) DESC, item_id) AS rank FROM c)" + _REF_SQL)
def question_only_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablation that ranks by question similarity."""
    kept, items, own = _stage_one(_unit(spark, sf_dir))
    return _references(retrieve.retrieve_steps(kept, items, own, 2, step_level=False))


@query("WITH " + _TWO_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY md5('17:' || vec_id || ':0:' || item_id), item_id) AS rank FROM c)" + _REF_SQL)
def random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control that draws steps by a hash instead of ranking them."""
    kept, items, own = _stage_one(_unit(spark, sf_dir))
    return _references(retrieve.retrieve_steps(kept, items, own, 2, random_seed=17))


@query("WITH " + _TWO_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(ss, 9) DESC, item_id) AS rank FROM c), r AS (SELECT vec_id, count(*) AS n, sum(qs) AS q, sum(ss) AS s FROM k WHERE rank <= 2 GROUP BY vec_id)
SELECT count(*) AS n_queries, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_references, count(*) FILTER (n IS NULL) AS n_empty, round(coalesce(sum(q) / sum(n), 0), 6) AS mean_question_similarity, round(coalesce(sum(s) / sum(n), 0), 6) AS mean_step_similarity FROM u LEFT JOIN r USING (vec_id)""")
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, items, own = _stage_one(_unit(spark, sf_dir))
    out = retrieve.retrieval_stats(retrieve.retrieve_steps(kept, items, own, 2), own)
    return out.select("n_queries", "n_references", "n_empty", F.round("mean_question_similarity", 6).alias("mean_question_similarity"), F.round("mean_step_similarity", 6).alias("mean_step_similarity"))


_WALK_SQL = _UNIT_SQL + """, qv AS (SELECT label, min(vec_id) AS first_id, arg_min(vec, vec_id) AS vec FROM u GROUP BY label),
p AS (SELECT u.vec_id AS query_id, qv.label AS item_id, list_dot_product(u.vec, qv.vec) AS sim, first_id = u.vec_id AS dup FROM u, qv),
v AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN sim >= 0.8 THEN 'similar' ELSE 'kept' END AS verdict FROM p),
w AS (SELECT *, coalesce(sum(CASE WHEN verdict = 'kept' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)"""


def _walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = _unit(spark, sf_dir)
    pool = u.groupBy(F.col("label").alias("item_id")).agg(F.min("vec_id").alias("own_id"), F.min_by("vec", "vec_id").alias("vec"))
    queries = u.select(F.col("vec_id").alias("query_id"), "vec")
    return retrieve.visited(queries, pool, 3, 0.8), queries.select("query_id")


@query("WITH " + _WALK_SQL + " SELECT query_id, item_id, verdict, CAST(before + 1 AS BIGINT) AS kept_rank FROM w WHERE before < 3")
def guard_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk down the ranking sees until it has kept three questions."""
    return _walked(spark, sf_dir)[0].select("query_id", "item_id", "verdict", F.col("kept_rank").cast("long").alias("kept_rank"))


@query("WITH " + _WALK_SQL + """, g AS (SELECT query_id, count(*) FILTER (verdict = 'kept') AS kept, count(*) FILTER (verdict = 'duplicate') AS dup, count(*) FILTER (verdict = 'similar') AS simi, sum(CASE WHEN verdict = 'kept' THEN sim END) AS total FROM w WHERE before < 3 GROUP BY query_id)
SELECT count(*) AS n_queries, CAST(sum(kept) AS BIGINT) AS n_kept, CAST(sum(dup) AS BIGINT) AS n_duplicates, CAST(sum(simi) AS BIGINT) AS n_similar, count(*) FILTER (kept = 0) AS n_empty, round(coalesce(sum(total) / sum(kept), 0), 6) AS mean_similarity FROM g""")
def guard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieve.guard_counters(*_walked(spark, sf_dir))
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("WITH " + _PAIRS_SQL + " SELECT query_id AS vec_id, round(max(sim), 6) AS max_similarity, max(sim) >= 0.95 AS near_duplicate FROM p WHERE item_id <> query_id GROUP BY query_id")
def near_duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's greatest similarity to another one."""
    u = _unit(spark, sf_dir)
    best = retrieve.topk_by_cosine(u.select(F.col("vec_id").alias("query_id"), "vec"), u.select(F.col("vec_id").alias("item_id"), "vec"), 1, drop_same=True)
    return best.select(F.col("query_id").alias("vec_id"), F.round("similarity", 6).alias("max_similarity"), (F.col("similarity") >= 0.95).alias("near_duplicate"))


@query("SELECT DISTINCT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)")
def verbatim_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand verbatim in a document."""
    return contamination.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item")), "doc_id", "text", "item_id", "item")


# the order of a draw: four Feistel rounds over two halves of b bits, mixed by md5
_DRAW_SQL = _UNIT_SQL + ", o AS (SELECT vec_id, vec, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal, count(*) OVER () AS n FROM u), " + """b AS (SELECT CAST(greatest(1, ceil(ceil(log2(max(n))) / 2)) AS INTEGER) AS b, CAST(max(n) AS BIGINT) AS n FROM o),
f0 AS (SELECT q.vec_id AS query_id, p.range AS place, b, n, p.range >> b AS l, p.range & ((1 << b) - 1) AS r FROM u q, b, range((SELECT least(1 << (2 * b), 64) FROM b)) p),
""" + ", ".join(f"f{k + 1} AS (SELECT query_id, place, b, n, r AS l, xor(l, CAST(('0x' || substr(md5('17:' || query_id || ':{k}:' || r), 1, 8)) AS BIGINT)) & ((1 << b) - 1) AS r FROM f{k})" for k in range(4)) + """,
d AS (SELECT query_id, place, o.vec_id AS item_id, list_dot_product(u.vec, o.vec) AS sim FROM f4 JOIN o ON ordinal = (l << b) | r JOIN u ON u.vec_id = query_id),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM d WHERE sim < 0.95 AND item_id <> query_id)"""


@query("WITH " + _DRAW_SQL + " SELECT query_id, item_id, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS similarity FROM w WHERE rank <= 8")
def random_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors drawn for each vector behind the guard, by a permutation that is computed and not searched."""
    u = _unit(spark, sf_dir)
    pool = gapless(u, F.floor(F.col("vec_id") / 10_000), ["vec_id"], "ordinal").select(F.col("vec_id").alias("item_id"), "ordinal", "vec")
    found = retrieve.draw(u.select(F.col("vec_id").alias("query_id"), "vec"), pool, 8, 17, 0.95, True)
    return found.select("query_id", F.inline("hits")).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


_FLAG_SQL = r"""k AS (SELECT doc_id, lang, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents),
p AS (SELECT DISTINCT t FROM k WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)),
g AS (SELECT lang, t IN (SELECT t FROM p) AS v FROM k WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""


@query("WITH " + _FLAG_SQL + " SELECT coalesce(lang, 'TOTAL') AS lang, count(*) AS n, count(*) FILTER (v) AS verbatim, round(100.0 * count(*) FILTER (v) / count(*), 1) AS verbatim_pct FROM g GROUP BY ROLLUP (lang)")
def contamination_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose normalised text equals a low-quality document's, by language and in all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    problems = docs.join(low, "doc_id", "left_anti").select(F.col("doc_id").alias("uid"), F.col("lang"), F.col("text").alias("problem"))
    pool = docs.join(low, "doc_id", "left_semi").select(F.col("text").alias("question"))
    flagged = contamination.flags(problems.select("uid", "lang"), contamination.verbatim(problems, pool, unicode=False))
    return contamination.report(flagged, "lang").drop("near_duplicate")


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents)
SELECT CAST(('0x' || substr(md5('0:' || tok), 1, 2)) AS BIGINT) AS bucket, count(*) AS n, count(DISTINCT tok) AS n_tokens FROM t GROUP BY 1""")
def hash_encoder_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the hashing encoder's 256 buckets fill; tokens are counted before they are hashed."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(hash_tokens("text")).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    return tokens.groupBy(hash_bucket(F.col("tok")).cast("long").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("n_tokens"))


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on their first eight principal axes, to unit length."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    model = encode.fit_projection(rows, 8)
    return encode.apply_projection(rows, model)


@query("WITH d AS (SELECT label, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS s FROM embeddings) SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(avg(sqrt(s)), 6) AS mean_norm FROM d GROUP BY 1")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(dot("embedding", "embedding"))), 6).alias("mean_norm"))


@query("WITH t AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT CAST(label AS BIGINT) AS label, vec_id FROM t WHERE r = 1")
def unique_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each question: the one that stands first."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("qid"), F.col("vec_id").alias("question"), F.col("vec_id").alias("ordinal"))
    return encode.unique_questions(rows).select(F.col("qid").cast("long").alias("label"), F.col("question").alias("vec_id"))


