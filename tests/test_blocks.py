"""Products in blocks: pruned nearest neighbours, draws, re-ranking of skewed questions."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gradeloom.operators import retrieve
from test_retrieve import vectors


def _named(df, name):
    return df.withColumnRenamed("id", name)


def _walk(sims, ids, query, k, below, drop_same, order=None):
    """A loop down the ranking: hits, the duplicates and the similar rows met."""
    hits, same, similar = [], 0, 0
    for j in order if order is not None else sorted(range(len(ids)), key=lambda j: (-round(sims[j], 9), ids[j])):
        if len(hits) == k:
            break
        if drop_same and ids[j] == query:
            same += 1
        elif below is not None and sims[j] >= below:
            similar += 1
        else:
            hits.append(ids[j])
    return hits, same, similar


@pytest.mark.parametrize(
    ("cluster_rows", "block_rows", "query_rows", "k", "below", "drop_same"),
    [(10**6, 10**6, 10**6, 5, 0.6, True), (12, 10**6, 10**6, 200, 0.3, True), (12, 5, 4, 5, 0.6, True), (1, 3, 2, 3, None, False), (10**6, 7, 3, 200, 0.3, True)],
)
def test_nearest_equals_a_loop(spark, cluster_rows, block_rows, query_rows, k, below, drop_same):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    v = np.concatenate([c + 0.3 * rng.normal(size=(15, 8)) for c in centres] + [np.zeros((2, 8))])
    v[7] = v[3]  # equal vectors tie
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    q = np.concatenate([v[:20], rng.normal(size=(6, 8)), np.zeros((1, 8))])
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    pool, queries = (spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, vec array<double>").repartition(3) for m in (v, q))
    got = retrieve.nearest(_named(queries, "query_id"), _named(pool, "item_id"), k, below, drop_same, cluster_rows=cluster_rows, block_rows=block_rows, query_rows=query_rows).collect()
    sims = q @ v.T
    assert sorted(r["query_id"] for r in got) == list(range(len(q)))
    for r in got:
        i = r["query_id"]
        assert ([h["item_id"] for h in r["hits"]], r["n_duplicates"], r["n_similar"]) == _walk(sims[i], list(range(len(v))), i, k, below, drop_same)
        assert [h["rank"] for h in r["hits"]] == list(range(1, len(r["hits"]) + 1))
        assert np.allclose([h["similarity"] for h in r["hits"]], [sims[i, h["item_id"]] for h in r["hits"]])


def test_clusters_are_skipped(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([c + 0.05 * rng.normal(size=(100, 16)) for c in rng.normal(size=(20, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pool = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    queries = pool.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    seen = Observation("products")
    got = retrieve.nearest(queries, pool, 5, drop_same=True, cluster_rows=100, products=seen)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(got.collect()) == 200 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    share = seen.get["done"] / (200 * len(v))
    assert share < 0.5  # most products beyond the nearest cluster are never made


def test_clusters_of_vectors_that_expressions_make(spark, sf_dir):
    from gradeloom.plans.retrieval_queries import _unit

    u = _unit(spark, sf_dir)  # floats, brought to unit length in the plan
    got = retrieve.topk_by_cosine(_named(u.select(F.col("vec_id").alias("id"), "vec"), "query_id"), _named(u.select(F.col("vec_id").alias("id"), "vec"), "item_id"), 3, below=0.95, drop_same=True, cluster_rows=100).collect()
    rows = sorted(u.select("vec_id", "vec").collect())
    ids, v = [r["vec_id"] for r in rows], np.array([r["vec"] for r in rows])
    sims = v @ v.T
    for i, x in enumerate(ids):
        assert [r["item_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == x] == _walk(sims[i], ids, x, 3, 0.95, True)[0]


def test_empty_sides(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, vec array<double>")
    q = p.withColumnRenamed("item_id", "query_id")
    assert retrieve.nearest(q.limit(0), p, 3).count() == retrieve.nearest(q, p.limit(0), 3).count() == 0
    assert retrieve.draw(q, p.withColumn("ordinal", F.lit(0)).limit(0), 3, 1).count() == 0


@pytest.mark.parametrize(("n", "below"), [(1, None), (2, None), (37, 0.2), (300, -0.2), (300, 0.5)])
def test_draws_are_a_walk_of_a_permutation(spark, n, below):
    from gradeloom.functions.vectors import draw_order

    v, pool = vectors(spark, n, 4)
    q, queries = vectors(spark, 6, 4, seed=2)
    pool = pool.select(F.col("id").alias("item_id"), F.col("id").alias("ordinal"), "vec")
    draw = lambda rows: {r["query_id"]: ([h["item_id"] for h in r["hits"]], r["n_duplicates"], r["n_similar"]) for r in retrieve.draw(_named(rows, "query_id"), pool, 3, 11, below, True).collect()}
    got = draw(queries)
    bits = max(1, -(-(n - 1).bit_length() // 2))
    for i in range(6):
        order = [r[0] for r in spark.range(1 << 2 * bits).select(draw_order("id", F.lit(i), 11, bits)).collect()]
        assert sorted(order) == list(range(1 << 2 * bits))
        want = _walk(q[i] @ v.T, list(range(n)), i, 3, below, True, [o for o in order if o < n])
        assert got.get(i, ([], 0, 0)) == want
    # a query draws the same rows whatever other queries there are: a resumed run draws what a whole one does
    assert draw(queries.where("id = 4")) == {4: got[4]}


@pytest.mark.parametrize(("block_rows", "query_rows"), [(10**6, 10**6), (8, 5), (1, 1)])
@pytest.mark.parametrize("mode", ["step", "question", "random"])
def test_a_question_with_half_of_all_steps(spark, block_rows, query_rows, mode):
    import hashlib

    v, items = vectors(spark, 60, 6)
    q, steps = vectors(spark, 24, 6, seed=5)
    items = items.select(F.col("id").alias("item_id"), F.when(F.col("id") < 30, 0).otherwise(F.col("id") % 5).alias("qid"), "vec")
    kept = spark.createDataFrame([(i, j, 0.1 * j) for i in range(24) for j in ((0, 1, 3) if i < 20 else (2, 4))], "query_id long, qid int, question_similarity double")
    steps = steps.select(F.col("id").alias("query_id"), F.lit(0).alias("step_index"), "vec")
    got = retrieve.retrieve_steps(kept, items, steps, 4, step_level=mode != "question", random_seed=3 if mode == "random" else None, block_rows=block_rows, query_rows=query_rows).collect()
    qid = lambda j: 0 if j < 30 else j % 5
    sims = np.round(q @ v.T, 9)
    for i in range(24):
        mine = [j for j in range(60) if qid(j) in ((0, 1, 3) if i < 20 else (2, 4))]
        order = {"step": lambda j: (-sims[i, j], j), "question": lambda j: (-qid(j), -sims[i, j], j), "random": lambda j: (hashlib.md5(f"3:{i}:0:{j}".encode()).hexdigest()[:13], j)}[mode]
        own = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["ref_rank"])
        assert [r["item_id"] for r in own] == sorted(mine, key=order)[:4]
        assert [r["ref_rank"] for r in own] == [1, 2, 3, 4] and all(r["qid"] == qid(r["item_id"]) and round(r["question_similarity"], 6) == round(0.1 * r["qid"], 6) for r in own)


def test_random_steps_are_not_hashed_one_by_one(spark):
    import hashlib
    import time

    n = 2000
    vec = F.array(F.lit(1.0), F.lit(0.0)).alias("vec")
    items = spark.range(n).select(F.col("id").alias("item_id"), F.lit(1).alias("qid"), vec)
    steps = spark.range(2 * n).select(F.col("id").alias("query_id"), F.lit(0).alias("step_index"), vec)
    kept = steps.select("query_id", F.lit(1).alias("qid"), F.lit(0.5).alias("question_similarity"))
    draw = lambda steps: sorted((r["query_id"], r["ref_rank"], r["item_id"]) for r in retrieve.retrieve_steps(kept, items, steps, 2, random_seed=5).collect())
    few = draw(steps.limit(1))
    began = time.time()
    got = draw(steps)
    took = time.time() - began
    began = time.time()
    own = [sorted(range(n), key=lambda k: hashlib.md5(f"5:{x}:0:{k}".encode()).hexdigest())[:2] for x in range(40)]
    one_by_one = (time.time() - began) * len(got) / 80
    assert [(x, place + 1, k) for x, ks in enumerate(own) for place, k in enumerate(ks)] == got[:80] and few == got[:2]
    assert took < one_by_one / 2, (took, one_by_one)
