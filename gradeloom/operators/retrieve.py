"""Two-stage exact cosine retrieval behind a contamination guard.

Stage 1 ranks pool questions for each distinct query question, not for each of its steps: in retrieved mode
the ranking depends on the question alone. Stage 2 ranks the steps of the kept questions for each query
step. In both, vectors stay on the executors: rows meet by key and are multiplied in blocks
(:mod:`.blocks`), and only each block's best cross the network again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.vectors import draw_order
from .blocks import best, matched, split_hot, vectors

#: rows that clusters are made for, and how many of them there are at most (what is broadcast is one vector for each)
CLUSTER_ROWS = 4_000
MOST_CLUSTERS = 4_096
#: rows of the pool that clusters' centres are fitted on, in expectation; every row is assigned and searched
FIT_ROWS = 20_000
#: items of one block, and queries of one deal
BLOCK_ROWS = 16_000
QUERY_ROWS = 20_000
#: the same where items are drawn by hashes, which takes some thirty times as long as a product
DRAWN_ROWS = 4_000
#: similarities are ranked to so many decimals, so that equal vectors tie whatever block they were multiplied in
DECIMALS = 9


def cluster_centres(pool: DataFrame, clusters: int, fit_rows: int = FIT_ROWS, rounds: int = 5, seed: int = 17):
    """Unit centres by spherical k-means over a sample of about ``fit_rows`` rows, drawn by the hash of their ids."""
    import numpy as np

    n = pool.count()
    share = max(1, n // fit_rows)
    rows = pool.where(F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(share)) == 0).select("vec").limit(4 * fit_rows).collect()
    x = np.array([r["vec"] for r in rows], float)
    if not len(x):
        return x
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:clusters]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _assigned(pool: DataFrame, centres) -> DataFrame:
    """``pool`` with its nearest centre and the angle to it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = vectors(b.column("vec")) @ centres.T
            at = x.argmax(1)
            angle = np.arccos(np.clip(x[np.arange(len(x)), at], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("vec"), pa.array(at.astype("i4")), pa.array(angle)], names=["item_id", "vec", "cluster", "angle"])

    # not a UDF of an expression: Spark 4.1 leaves one unevaluated in the aggregation when the vector is made by aggregate() and transform()
    rows = pool.select("item_id", F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"item_id {pool.schema['item_id'].dataType.simpleString()}, vec array<double>, cluster int, angle double")


def _score_block(k: int, below: float | None, drop_same: bool):
    """The ``k`` best allowed items of some queries in a block; what the guard drops comes as counts, but the query's own row, which comes as a row."""

    def score(q, vecs, i, matrix):
        import numpy as np
        import pyarrow as pa

        sims = vecs @ matrix.T
        keys = -np.round(sims, DECIMALS)
        dropped = np.zeros(len(q), "i8")
        same_row, same_at = np.zeros(0, int), np.zeros(0, int)
        if drop_same:
            at = {x: n for n, x in enumerate(i.to_pylist())}
            pairs = [(row, at[x]) for row, x in enumerate(q.to_pylist()) if x in at]
            if pairs:
                same_row, same_at = np.array(pairs).T
        if below is not None:
            over = sims >= below
            over[same_row, same_at] = False
            dropped = over.sum(1)
            keys[over] = np.inf
        keys[same_row, same_at] = np.inf
        row, column = best(keys, k)
        some = np.flatnonzero(dropped)
        rows = np.concatenate([row, same_row, some])
        mark = np.repeat(np.array([0, 1, 2], "i1"), [len(row), len(same_row), len(some)])
        none = np.concatenate([np.zeros(len(row) + len(same_row), bool), np.ones(len(some), bool)])
        picked = np.concatenate([column, same_at, np.zeros(len(some), int)])
        found = pa.array(sims[rows, picked] if len(rows) else np.zeros(0), mask=none)
        ids = i.take(pa.array(picked, mask=none))
        return q.take(pa.array(rows)), ids, found, pa.array(mark), pa.array(np.concatenate([np.zeros(len(rows) - len(some), "i8"), dropped[some]]))

    return score


def _scored(queries: DataFrame, items: DataFrame, k: int, below: float | None, drop_same: bool, block_rows: int, query_rows: int) -> DataFrame:
    """(query, item_id, similarity, mark, dropped) of ``queries(query, cluster, vec)`` in the blocks of their clusters."""
    qt, it = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query"), (items, "item")))
    queries, items = split_hot(queries, items, "cluster", F.col("item"), F.col("query"), block_rows, query_rows)
    return matched(queries, items, ["cluster", "_block", "_deal"], _score_block(k, below, drop_same), f"query {qt}, item_id {it}, similarity double, mark byte, dropped long")


def nearest(queries: DataFrame, pool: DataFrame, k: int, below: float | None = None, drop_same: bool = False, cluster_rows: int = CLUSTER_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, products: Observation | None = None) -> DataFrame:
    """(query_id, hits, n_duplicates, n_similar): the ``k`` nearest pool rows of each query, exactly, with what the guard dropped on the way.

    ``queries(query_id, vec)``, ``pool(item_id, vec)`` with vectors of unit length or zero. ``hits`` are structs of
    rank, item_id and similarity; ties (to nine decimals) go to the smaller item_id. A query that met nothing
    at all has no row. The guard leaves out similarities at or above ``below``, and with ``drop_same`` the row
    whose item_id is the query_id, before the ranking; both are counted as far as a walk down the ranking
    that stops at the k-th kept row meets them.

    The pool is cut into clusters. A query is compared with its nearest cluster first; what it finds there bounds
    its k-th similarity from below. The angle to a cluster's centre less the cluster's radius bounds from above
    what any of its rows can reach (triangle inequality of angles), and clusters that can't reach the k-th are
    skipped. ``products`` observes ``done``, the products that were made.
    """
    n, d = pool.agg(F.count("*"), F.max(F.size("vec"))).first()
    clusters = min(MOST_CLUSTERS, -(-n // cluster_rows))
    items = pool.select(F.col("item_id").alias("item"), "vec")
    own = queries.select(F.col("query_id").alias("query"), "vec")
    if clusters <= 1:
        if products:
            own = own.observe(products, (F.count("*") * F.lit(n)).alias("done"))
        parts = _scored(own.withColumn("cluster", F.lit(0)), items.withColumn("cluster", F.lit(0)), k, below, drop_same, block_rows, query_rows)
        return _walk(parts, k)
    centres = cluster_centres(pool, clusters)
    placed = _assigned(pool, centres)
    found = {r["cluster"]: (r["n"], r["radius"]) for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row for each cluster
    items = placed.select(F.col("item_id").alias("item"), "vec", "cluster")
    import numpy as np

    names = np.array(sorted(found), "i8")
    sizes, radii = (np.array([found[c][x] for c in names.tolist()]) for x in (0, 1))
    at = centres[names]
    qt = own.schema["query"].dataType.simpleString()

    def candidates(home: bool):
        """Clusters that a query has to visit: the nearest one, or those others that can reach its k-th similarity."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                angles = np.arccos(np.clip(vectors(b.column("vec")).reshape(b.num_rows, d) @ at.T, -1, 1))
                # a zero vector has no angle; its similarities are all 0
                reach = np.where(np.linalg.norm(vectors(b.column("vec")), axis=1, keepdims=True) > 0.5, np.cos(np.maximum(angles - radii, 0)), 0.0)
                first = reach.argmax(1)
                if home:
                    row, column = np.arange(b.num_rows), first
                else:
                    least = b.column("least").to_numpy(zero_copy_only=False).astype(float)
                    open_ = reach + 1e-7 >= np.where(np.isnan(least), -np.inf, least)[:, None]
                    open_[np.arange(b.num_rows), first] = False
                    row, column = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(row)), b.column("vec").take(pa.array(row)), pa.array(names[column].astype("i4")), pa.array(sizes[column].astype("i8"))], names=["query", "vec", "cluster", "size"])

        return run

    schema = f"query {qt}, vec array<double>, cluster int, size long"
    own = own.withColumn("vec", F.col("vec").cast("array<double>"))
    first = _scored(own.mapInArrow(candidates(True), schema).drop("size"), items, k, below, drop_same, block_rows, query_rows).persist()  # a few rows a query, read for their bound and as results
    kept = first.where("mark = 0").groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("least"))
    rest = own.join(kept, "query", "left").mapInArrow(candidates(False), schema)
    if products:
        rest = rest.observe(products, F.sum("size").alias("done"))
    return _walk(first.union(_scored(rest.drop("size"), items, k, below, drop_same, block_rows, query_rows)), k)


def _walk(parts: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("mark", F.desc(F.round("similarity", DECIMALS)), "item_id"))
    kept = F.col("mark") == 0
    rows = parts.withColumn("rank", place).where(~kept | (F.col("rank") <= k))
    hit = F.struct("rank", "item_id", "similarity")
    own = F.max(F.when(F.col("mark") == 1, F.struct("similarity", F.lit(True).alias("_"), "item_id")))
    out = rows.groupBy(F.col("query").alias("query_id")).agg(F.sort_array(F.collect_list(F.when(kept, hit))).alias("hits"), own.alias("own"), F.sum("dropped").alias("n_similar"))
    last = F.get("hits", F.size("hits") - 1)
    ahead, level = (F.round(c, DECIMALS) for c in ("own.similarity", last["similarity"]))
    # the walk meets the query's own row unless it has kept k before it
    before = (ahead > level) | ((ahead == level) & (F.col("own.item_id") < last["item_id"]))
    met = F.col("own").isNotNull() & ((F.size("hits") < k) | before)
    return out.select("query_id", "hits", F.coalesce(met, F.lit(False)).cast("long").alias("n_duplicates"), F.col("n_similar").cast("long").alias("n_similar"))


def draw(queries: DataFrame, pool: DataFrame, k: int, seed: int, below: float | None = None, drop_same: bool = False) -> DataFrame:
    """Like :func:`nearest`, but rows are met in a random order that seed and query decide, not by similarity.

    ``pool(item_id, ordinal, vec)`` with gapless ordinals from 0; a row is the query's own if its item_id is the query's
    own_id (query_id, if queries have no such column). The order is a keyed permutation of the ordinals
    (a Feistel network over md5), so a query's draws are computed, not searched: places are turned into ordinals
    and joined with the pool, a few more than ``k`` of them at first. Queries whose guard dropped too many draw
    twice as many places in the next round, until they have k rows or all places are used. The same queries
    draw the same rows in any run, and the work is that of the rows drawn.
    """
    n = pool.count()
    if not n:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, hits array<struct<rank:int,item_id:{pool.schema['item_id'].dataType.simpleString()},similarity:double>>, n_duplicates long, n_similar long")
    bits = max(1, -(-(n - 1).bit_length() // 2))
    places = 1 << 2 * bits
    # places beyond the ordinals are passed over: at least a quarter of them are none
    todo, done, upto = queries.select("query_id", F.col("own_id" if "own_id" in queries.columns else "query_id").alias("own_id"), "vec"), None, min(places, max(16, 8 * k))
    sims = similarity_of("vec", "_vec")
    same = (F.col("own_id") == F.col("item_id")) if drop_same else F.lit(False)
    verdict = F.when(same, 1).when((F.col("similarity") >= below) if below is not None else F.lit(False), 2).otherwise(0)
    while True:
        drawn = todo.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(upto - 1).cast("long"))))
        drawn = drawn.withColumn("ordinal", draw_order("place", "query_id", seed, bits)).where(F.col("ordinal") < n)
        met = drawn.join(pool.select("ordinal", "item_id", F.col("vec").alias("_vec")), "ordinal").withColumn("similarity", sims).withColumn("mark", verdict).drop("vec", "_vec")
        before = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        walked = met.withColumn("_kept", F.coalesce(F.sum((F.col("mark") == 0).cast("int")).over(before), F.lit(0))).where(F.col("_kept") < k)
        hit = F.when(F.col("mark") == 0, F.struct((F.col("_kept") + 1).cast("int").alias("rank"), "item_id", "similarity"))
        rows = walked.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"), F.count_if(F.col("mark") == 1).alias("n_duplicates"), F.count_if(F.col("mark") == 2).alias("n_similar"))
        if upto >= places:
            return rows if done is None else done.union(rows)
        rows = rows.persist()  # read by the test below and by the result
        ended = rows.where(F.size("hits") >= k)
        done = ended if done is None else done.union(ended)
        todo = todo.join(ended.select("query_id"), "query_id", "left_anti")
        if todo.isEmpty():
            return done
        upto = min(places, 2 * upto)


def similarity_of(a: str, b: str):
    """Products of two vector columns, one for each row, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x, y):
        import numpy as np

        return x.__class__([float(np.dot(u, v)) for u, v in zip(x, y, strict=True)])

    return run(a, b)


def topk_by_cosine(queries: DataFrame, pool: DataFrame, k: int, below: float | None = None, drop_same: bool = False, **sizes) -> DataFrame:
    """(query_id, item_id, similarity, rank): the rows of :func:`nearest`, one for each hit."""
    found = nearest(queries, pool, k, below, drop_same, **sizes)
    return found.select("query_id", F.inline("hits")).select("query_id", "item_id", "similarity", "rank")


def visited(queries: DataFrame, pool: DataFrame, k: int, threshold: float = 0.95, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """What :func:`guard_walk` sees of ``queries(query_id, vec)`` over ``pool(item_id, own_id, vec)``; a row is the query's own if own_id is the query_id."""
    asked = queries.select(F.lit(0).alias("all"), F.col("query_id").alias("query"), "vec")
    own = pool.select(F.lit(0).alias("all"), F.struct("item_id", "own_id").alias("item"), "vec")
    asked, own = split_hot(asked, own, "all", F.col("item"), F.col("query"), block_rows, query_rows)

    def score(q, vecs, i, matrix):
        import numpy as np
        import pyarrow as pa

        sims = vecs @ matrix.T
        same = np.array(q.to_pylist(), object)[:, None] == np.array(i.field("own_id").to_pylist(), object)[None]
        dropped = same | (sims >= threshold)
        row, column = best(np.where(dropped, np.inf, -np.round(sims, DECIMALS)), k)
        gone, at = np.nonzero(dropped)
        row, column = np.concatenate([row, gone]), np.concatenate([column, at])
        return q.take(pa.array(row)), i.field("item_id").take(pa.array(column)), pa.array(sims[row, column]), pa.array(same[row, column])

    qt, it = queries.schema["query_id"].dataType.simpleString(), pool.schema["item_id"].dataType.simpleString()
    ranked = matched(asked, own, ["all", "_block", "_deal"], score, f"query_id {qt}, item_id {it}, similarity double, is_duplicate boolean")
    return guard_walk(ranked, k, threshold, order=(F.desc(F.round("similarity", DECIMALS)), F.col("item_id")))


def guard_walk(ranked: DataFrame, k: int, threshold: float = 0.95, query: str = "query_id", order: tuple | None = None) -> DataFrame:
    """Candidates that a walk in rank order visits until it has kept ``k``, each with its ``verdict``.

    Verdicts: ``duplicate`` (``is_duplicate``, checked first), ``similar`` (similarity at or above the
    threshold) or ``kept``. Rows after the k-th kept one are not visited and not returned.
    """
    order = order or (F.desc("similarity"), F.col("item_id"))
    verdict = F.when(F.col("is_duplicate"), "duplicate").when(F.col("similarity") >= threshold, "similar").otherwise("kept")
    before = Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    walked = ranked.withColumn("verdict", verdict)
    walked = walked.withColumn("_kept", F.coalesce(F.sum((F.col("verdict") == "kept").cast("int")).over(before), F.lit(0)))
    return walked.where(F.col("_kept") < k).withColumn("kept_rank", F.col("_kept") + 1).drop("_kept")


def guard_counters(walked: DataFrame, queries: DataFrame, query: str = "query_id") -> DataFrame:
    """Totals over all queries, also those for which nothing was kept."""
    own = walked.groupBy(query).agg(F.count_if(F.col("verdict") == "kept").alias("kept"), F.count_if(F.col("verdict") == "duplicate").alias("dup"), F.count_if(F.col("verdict") == "similar").alias("sim"), F.sum(F.when(F.col("verdict") == "kept", F.col("similarity"))).alias("total"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return queries.select(query).join(own, query, "left").agg(
        F.count("*").alias("n_queries"), zero("kept").alias("n_kept"), zero("dup").alias("n_duplicates"), zero("sim").alias("n_similar"),
        F.count_if(F.coalesce("kept", F.lit(0)) == 0).alias("n_empty"), F.coalesce(F.try_divide(zero("total"), zero("kept")), F.lit(0.0)).alias("mean_similarity"),
    )


def _named(value) -> str:
    """A value as Spark casts it to a string, structs of plain fields included."""
    return "{" + ", ".join(map(_named, value.values())) + "}" if isinstance(value, dict) else str(value)


def retrieve_steps(kept: DataFrame, items: DataFrame, query_steps: DataFrame, top_k: int, step_level: bool = True, random_seed: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """References of each query step from the steps of its kept questions.

    ``kept(query_id, qid, question_similarity)``, ``items(item_id, qid, vec)``, ``query_steps(query_id,
    step_index, vec)``. Ranks by step similarity, by the question's (``step_level=False``), or at random (by the
    first 52 bits of an md5). A question's steps and the query steps that kept it meet once: one product a
    block, whose ``top_k`` best are all that leaves it.
    """
    asked = query_steps.select("query_id", "step_index", "vec").join(kept.select("query_id", "qid", "question_similarity"), "query_id")
    asked = asked.select("qid", F.struct("query_id", "step_index", "qid", "question_similarity").alias("query"), "vec")
    own = items.select("qid", F.col("item_id").alias("item"), "vec")
    asked, own = split_hot(asked, own, "qid", F.col("item"), F.col("query"), block_rows, query_rows if random_seed is None else min(query_rows, DRAWN_ROWS))

    def score(q, vecs, i, matrix):
        import numpy as np
        import pyarrow as pa

        if random_seed is None:
            sims = vecs @ matrix.T
            keys = -np.round(sims, DECIMALS)  # inside one question its own similarity is the same for all
            row, column = best(keys, top_k)
            return q.take(pa.array(row)), i.take(pa.array(column)), pa.array(sims[row, column]), pa.array(keys[row, column])
        from ..functions.digests import Digests

        drawn = Digests([str(n).encode() for n in i.to_pylist()])
        high, low = drawn.words([(f"{random_seed}:{x['query_id']}:{_named(x['step_index'])}:".encode(), b"") for x in q.to_pylist()], n=2)
        # the first 32 bits leave few rows whose other bits and products are needed
        few = high <= np.partition(high, top_k - 1, axis=1)[:, top_k - 1 : top_k] if top_k < high.shape[1] else np.ones(high.shape, bool)
        row, column = np.nonzero(few)
        keys = high[row, column] * float(1 << 20) + (low[row, column] >> 12)
        order = np.lexsort((column, keys, row))
        row, column, keys = row[order], column[order], keys[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < top_k
        row, column, keys = row[kept], column[kept], keys[kept]
        return q.take(pa.array(row)), i.take(pa.array(column)), pa.array(np.einsum("ij,ij->i", vecs[row], matrix[column])), pa.array(keys)

    qt, it = (df.schema[c].dataType.simpleString() for df, c in ((asked, "query"), (own, "item")))
    found = matched(asked, own, ["qid", "_block", "_deal"], score, f"query {qt}, item_id {it}, step_similarity double, _key double")
    found = found.select("query.*", "item_id", "step_similarity", "_key")
    first = [] if step_level or random_seed is not None else [F.desc("question_similarity")]
    place = F.row_number().over(Window.partitionBy("query_id", "step_index").orderBy(*first, "_key", "item_id"))
    return found.withColumn("ref_rank", place).where(F.col("ref_rank") <= top_k).drop("_key")


def retrieval_stats(references: DataFrame, query_steps: DataFrame) -> DataFrame:
    """Queries, references, empty results and mean similarities; means are 0 without references."""
    own = references.groupBy("query_id", "step_index").agg(F.count("*").alias("n"), F.sum("question_similarity").alias("q"), F.sum("step_similarity").alias("s"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return query_steps.select("query_id", "step_index").join(own, ["query_id", "step_index"], "left").agg(
        F.count("*").alias("n_queries"), zero("n").alias("n_references"), F.count_if(F.col("n").isNull()).alias("n_empty"),
        F.coalesce(F.try_divide(zero("q"), zero("n")), F.lit(0.0)).alias("mean_question_similarity"), F.coalesce(F.try_divide(zero("s"), zero("n")), F.lit(0.0)).alias("mean_step_similarity"),
    )
