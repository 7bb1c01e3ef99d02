"""Operator 1: n-gram Jaccard join by rare-first prefix filtering.

1. One scan makes every document's shingle set, a digest of it, and blocks of (shingle, document) for
   ranges of shingle hashes. Documents with equal sets form one node, named after the smallest id.
2. Blocks of a range meet in one task, which counts in how many documents each shingle occurs and sends
   those that occur more than once back to the chunk of documents they came from, with their count.
3. A chunk puts each node's shingles in order, rare ones first: those that occur once need not be seen,
   only how many there are. The prefix is so long that two sets that reach the threshold share a shingle
   of both prefixes; its repeated shingles become postings.
4. Postings that meet form lists. Pairs pass the length and positional filters as they are made, and each
   pair is verified once: a suffix filter over partitions of both sets, then the exact intersection.
5. Only components are asked for, so a list is first joined with one of its nodes, the hub (linear in
   the list, also for groups of any size); lists whose nodes have become one component are finished. A
   few rounds with other hubs shrink the rest, whose pairs across components are then all compared, so
   that no link between components can be missed.

Hot shingles: a chunk sends a shingle that many of its documents share as one entry with a count; lists
are made by a count with partial aggregation and a join that splits hot keys.

Defined cases: a null or empty text has no shingles, is its own component and links with nothing; a
null doc_id has a null component and takes part in no link; rows that repeat a doc_id are one node with
the sets of all of them; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held, sliced, spread, table, text_bytes
from .components import components
from .shingles import Shingler

#: bits of a shingle's hash that candidates are found by; verification takes all 64
KEY_BITS = 48
CHUNK_SHINGLES = 1_000_000
CHUNK_DOCS = 30_000
#: from so many documents of a chunk on, a shingle travels as one entry with a count
LOCALLY_HOT = 64
PARTS = 64
HUB_ROUNDS = 3
_SCAN = "chunk long, part int, idx int, doc_id long, digest binary, n long, m long, data binary"


def _part_bits(docs: DataFrame, part_bytes: int = 4 << 20) -> int:
    """How many ranges of hashes (a power of two): about one for each ``part_bytes`` of input by Spark's own estimate."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(20, max(6, (size // part_bytes).bit_length()))


def _scan(docs: DataFrame, k: int, part_bits: int) -> DataFrame:
    """A row for each document (part is null) and one for each block of a chunk.

    ``data`` is, for a document, null; for part >= 0 a block; for part -1 the chunk's locally hot
    shingles with the documents that have them.
    """

    key_bits, low = KEY_BITS, KEY_BITS - 32

    def run(it):
        import pickle

        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        shingler, part = held(Shingler, k), TaskContext.get().partitionId()
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        names = ["chunk", "part", "idx", "doc_id", "digest", "n", "m", "data"]
        made, size, docs_, keys_ = 0, 0, [], []

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def flush():
            chunk = (part << 24) | made
            yield batch([(chunk, None, i, d, h, n, len(k), None) for i, ((d, h, n), k) in enumerate(zip(docs_, keys_, strict=True))])
            idx = np.repeat(np.arange(len(keys_), dtype=np.uint16), [len(x) for x in keys_])
            keys = np.concatenate(keys_)
            order = np.argsort(keys, kind="stable")
            keys, idx = keys[order], idx[order]
            found, first, counts = np.unique(keys, return_index=True, return_counts=True)
            hot = counts >= LOCALLY_HOT
            cold = ~np.repeat(hot, counts)
            hot_keys, hot_counts = found[hot], counts[hot].astype(np.uint32)
            rows = []
            if hot.any():
                rows.append((chunk, -1, None, None, None, None, None, pickle.dumps((hot_keys, hot_counts, idx[~cold]), protocol=5)))
            keys, idx = keys[cold], idx[cold]
            edges = (np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(key_bits - part_bits)).astype(np.uint64)
            at, at_hot = np.searchsorted(keys, edges), np.searchsorted(hot_keys, edges)
            for p in range(1 << part_bits):
                a, b, c, d = at[p], at[p + 1], at_hot[p], at_hot[p + 1]
                if b > a or d > c:
                    step = np.diff((keys[a:b] >> np.uint64(low)).astype(np.uint32), prepend=np.uint32(int(edges[p]) >> low))
                    step = step.astype(np.uint16) if not len(step) or step.max() < 65536 else step
                    rows.append((chunk, p, None, None, None, None, None, pickle.dumps((step, keys[a:b].astype(np.uint16), idx[a:b], hot_keys[c:d], hot_counts[c:d]), protocol=5)))
            for r in range(0, len(rows), 256):
                yield batch(rows[r : r + 256])

        for b in sliced(it):
            for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), strict=True):
                s = shingler.set(t)
                docs_.append((d, xxhash.xxh3_128_digest(s.tobytes()), len(s)))
                keys_.append(np.unique(s >> np.uint64(64 - key_bits)))
                size += len(s)
                if size >= CHUNK_SHINGLES or len(docs_) >= CHUNK_DOCS:
                    yield from flush()
                    made, size, docs_, keys_ = made + 1, 0, [], []
        if docs_:
            yield from flush()

    return docs.mapInArrow(run, _SCAN)


def _repeated(blocks: DataFrame, part_bits: int) -> DataFrame:
    """For each chunk, its entries whose shingle occurs in more documents, with the number of documents."""

    key_bits, low_bits = KEY_BITS, KEY_BITS - 32

    def run(key, rows):
        import pickle

        import numpy as np
        import pyarrow as pa

        start = key[0].as_py() << (key_bits - part_bits - low_bits)
        chunks, keys, idx, weights = [], [], [], []
        own = rows.column("chunk").to_pylist()
        for i, data in enumerate(rows.column("data").to_pylist()):
            step, low, docs_, hot_keys, hot_counts = pickle.loads(data)
            high = np.cumsum(step.astype(np.uint64)) + np.uint64(start)
            keys += [(high << np.uint64(low_bits)) | low, hot_keys]
            idx += [docs_, np.full(len(hot_keys), 65535, np.uint16)]
            weights += [np.ones(len(low), np.uint32), hot_counts]
            chunks.append(np.full(len(low) + len(hot_keys), i, np.int64))
        keys, idx, weights, chunks = np.concatenate(keys), np.concatenate(idx), np.concatenate(weights), np.concatenate(chunks)
        _, where = np.unique(keys, return_inverse=True)
        df = np.bincount(where, weights=weights)[where].astype(np.uint32)
        more = df > 1
        keys, idx, df, chunks = keys[more], idx[more], df[more], chunks[more]
        order = np.argsort(chunks, kind="stable")
        keys, idx, df = keys[order], idx[order], df[order]
        edges = np.searchsorted(chunks[order], np.arange(len(own) + 1))
        out = [(own[i], pickle.dumps((keys[a:b], idx[a:b], df[a:b]), protocol=5)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["chunk", "data"])

    return blocks.groupBy("part").applyInArrow(run, "chunk long, data binary")


def _postings(nodes: DataFrame, repeated: DataFrame, percent: int) -> DataFrame:
    """Postings (h, node, n, pos) of the nodes' prefixes, from their chunks.

    ``nodes``: (chunk, idx, node, n, m), with m the number of different keys; ``repeated``: (chunk, hot, data), where ``hot`` marks the chunk's own
    locally hot shingles.
    """

    def run(key, own, rows):
        import pickle

        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
        keys, idx, df, hot_keys, hot_df, local = [], [], [], [], [], None
        for hot, data in zip(rows.column("hot").to_pylist(), rows.column("data").to_pylist(), strict=True):
            if hot:
                local = pickle.loads(data)
            else:
                k, i, d = pickle.loads(data)
                cold = i != 65535
                keys.append(k[cold])
                idx.append(i[cold])
                df.append(d[cold])
                hot_keys.append(k[~cold])
                hot_df.append(d[~cold])
        if local is not None:  # the counts of locally hot shingles, for each document that has them
            k, counts, docs_ = local
            hot_keys, hot_df = np.concatenate(hot_keys), np.concatenate(hot_df)
            order = np.argsort(hot_keys)
            of = hot_df[order][np.searchsorted(hot_keys[order], k)]
            keys.append(np.repeat(k, counts))
            idx.append(docs_)
            df.append(np.repeat(of, counts))
        if not keys or not own.num_rows:
            return schema.empty_table()
        keys, idx, df = np.concatenate(keys), np.concatenate(idx), np.concatenate(df)
        sizes, different, names = (np.zeros(65536, np.int64) for _ in range(3))
        at = own.column("idx").to_numpy()
        sizes[at], different[at], names[at] = (own.column(c).to_numpy() for c in ("n", "m", "node"))
        mine = sizes[idx] > 0
        keys, idx, df = keys[mine], idx[mine], df[mine]
        order = np.lexsort((keys, df, idx))
        keys, idx = keys[order], idx[order]
        starts = np.searchsorted(idx, np.arange(65537))
        count = np.diff(starts)
        n = sizes[idx]
        # shingles that occur once stand first. Shingles of a set that share a key count once, so a position is
        # never later than the shingle's own: prefixes are no shorter, and the positional filter loses nothing
        pos = (different[idx] - count[idx]) + np.arange(len(idx)) - starts[idx]
        keep = pos < n - (-(-percent * n // 100)) + 1
        return pa.table([pa.array(keys[keep].astype(np.int64)), pa.array(names[idx[keep]]), pa.array(n[keep]), pa.array(pos[keep])], schema=schema)

    return nodes.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(run, "h long, node long, n long, pos long")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(it):
        import pyarrow as pa

        shingler = held(Shingler, k)
        for b in sliced(it):
            sets = [shingler.set(t).tobytes() for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes binary")


def similar(x, y, percent: int) -> bool:
    """Whether two sorted hash arrays reach the threshold: the suffix filter first, then the intersection."""
    import numpy as np

    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if min(len(x), len(y)) < need:
        return False
    # elements of different partitions never match, so the sizes' differences bound the overlap
    apart = np.abs(np.bincount((x & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) - np.bincount((y & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)).sum()
    if (len(x) + len(y) - apart) // 2 < need:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= need


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        for b in sliced(it):
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_())) if ok else b.select(["a", "b"])

    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    return scratch.save(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "edges")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    part_bits = _part_bits(docs)
    scan = scratch.save(_scan(spread(docs), k, part_bits), "scan")
    rows = scratch.save(scan.where("part is null").select("chunk", "idx", "doc_id", "digest", "n", "m"), "rows")
    known = rows.where("n > 0 and doc_id is not null")
    classes = scratch.save(known.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")

    repeated = _repeated(scan.where("part >= 0").select("part", "chunk", "data"), part_bits)
    repeated = repeated.select("chunk", F.lit(False).alias("hot"), "data").union(scan.where("part = -1").select("chunk", F.lit(True).alias("hot"), "data"))
    nodes = known.join(classes, "digest").where("doc_id = node").select("chunk", "idx", "node", "n", "m")
    postings = scratch.save(_postings(nodes, repeated, percent), "postings")
    scratch.drop(scan)
    shared = postings.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1").select("h", "hub")
    lists = scratch.save(postings.join(shared, "h"), "lists")
    scratch.drop(postings)
    # every pair comes from the lists, so the sets of their nodes are made once
    sets = scratch.save(_sets(docs.join(lists.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), k), "sets")

    def fits(a: str, b: str):
        """Length and positional filters at a shared shingle, which a true pair passes at its first one."""
        n, m, p, q = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - p, m - q) * (100 + percent) >= (n + m) * percent)

    # a doc_id that repeats with other texts ties their classes together
    tied = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    tied = known.join(tied, "doc_id").join(classes, "digest").where("doc_id <> node")
    edges = scratch.save(tied.select(F.least("node", "doc_id").alias("a"), F.greatest("node", "doc_id").alias("b")).distinct(), "tied")
    seen = roots = None
    for step in range(HUB_ROUNDS + 1):
        if step == 0:
            open_lists = lists
        else:
            rooted = lists.drop("hub").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            more = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", F.lit(step))).alias("hub")).where("lo <> hi")
            # from here on only lists that still hold several components are read
            open_lists = scratch.save(rooted.join(more.select("h", "hub", "c"), "h"), "open")
            left, pairs_left = open_lists.agg(F.count("*"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).first()
            if not left:
                break
            if step == HUB_ROUNDS or pairs_left <= 64 * left:
                step = HUB_ROUNDS
            lists = open_lists.drop("c", "root")
        if step < HUB_ROUNDS:
            x = open_lists.alias("x")
            y = open_lists.where("node = hub").alias("y")
            met = x.join(y, F.col("x.h") == F.col("y.h")).where((F.col("x.node") != F.col("y.node")) & fits("x", "y"))
            if step:
                met = met.where("x.root <> y.root")
        else:
            x, y = open_lists.alias("x"), open_lists.alias("y")
            met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & fits("x", "y"))
        pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        found = _verify(pairs, sets, percent, scratch)
        seen = pairs if seen is None else seen.union(pairs)
        edges = edges.union(found)
        roots = scratch.save(components(edges, scratch), "roots")
        if step == HUB_ROUNDS:
            break

    final = scratch.save(classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id")), "final")
    scratch.drop(sets)
    out = rows.join(final, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN g x ON x.doc_id = p.a JOIN g y ON y.doc_id = p.b WHERE 100 * o >= 80 * (len(x.s) + len(y.s) - o)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN t ON r.m = t.a)
SELECT g.doc_id, CAST(len(any_value(g.s)) AS BIGINT) AS n_shingles, min(m) AS component_id FROM g JOIN r ON r.doc_id = g.doc_id GROUP BY g.doc_id
"""
