"""Operator 9: benchmark decontamination by a distributed positional inverted index.

Documents are indexed in segments, each made by one task from a bounded number of tokens: for each term
one row with the sorted list of its positions. Positions count through all documents of a segment, with
a gap after each, so that one list intersection covers all of them and no match spans two. The index is
stored once and holds the benchmark's terms; no other posting could take part in a match. A benchmark of
more than ``VOCABULARY`` terms is indexed in groups of items, which bounds what workers hold.

Items are matched in blocks of bounded size, each against the stored index. A window is looked up by its
rarest term (by postings in the whole index): a segment's terms name the windows to try, of which those
stay that have all their terms there. Their lists are intersected from the segment's rarest term on, each
shifted by its offset, and stop as soon as nothing is left.

Defined cases: a null or empty text has no words and is not contaminated; an item without words has no
window; an item of fewer than ``width`` words is one window; items that repeat a text are all reported, rows
that repeat an item_id as one item; rows that repeat a doc_id are judged each for itself; a null item_id
counts as occurring in ``n_items`` but has no text in ``item_ids``; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, Scratch, sliced, spread, table, text_bytes

WIDTH = 13
#: words that may stand between those of a window for a proximity match
SLOP = 3
SEGMENT_TOKENS = 4_000_000
#: bytes of text in a block of items; its windows take about six times as much in each worker
BLOCK_BYTES = 8 << 20
#: terms (of 8 bytes) of the benchmark that workers hold while they index
VOCABULARY = 8_000_000
_WORD = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: bytes of words stay, A-Z become lower case, everything else becomes a space
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))
_INDEX = "segment long, term long, df long, positions binary, docs binary"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def term_key(word: bytes) -> int:
    """A term's 64-bit hash; 0 marks a segment's documents."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(word) or 1) - (1 << 63)


class Phrases:
    """The different windows of a block of items, as places in the block's tokens.

    ``terms`` are the block's terms in order, ``tokens`` their numbers along the items; window ``w`` is
    ``tokens[start[w] : start[w] + length[w]]`` and occurs in the items ``owner[first[w] : first[w + 1]]``.
    """

    def __init__(self, items: list[tuple], width: int):
        import numpy as np

        self.items = [i for i, _ in items]
        keys, starts, lengths, owners, at = [], [], [], [], 0
        known = Cache(term_key, 1_000_000)
        for k, (_, text) in enumerate(items):
            own = [known[w] for w in words((text or "").encode())]
            if own:
                keys.append(np.array(own, np.int64))
                n = max(1, len(own) - width + 1)
                starts.append(np.arange(at, at + n))
                lengths.append(np.full(n, min(width, len(own))))
                owners.append(np.full(n, k))
                at += len(own)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.terms, tokens = np.unique(cat(keys), return_inverse=True)
        self.tokens = tokens.astype(np.int32)
        start, length, owner = cat(starts), cat(lengths), cat(owners)
        order = np.lexsort((start, length, *(self.tokens[np.minimum(start + j, start + length - 1)] for j in range(width)))) if at else start
        start, length, owner = start[order], length[order], owner[order]
        same = np.zeros(len(start), bool)  # as the window before it
        if len(start):
            same[1:] = length[1:] == length[:-1]
            for j in range(width):
                own = self.tokens[np.minimum(start + j, start + length - 1)]
                same[1:] &= own[1:] == own[:-1]
        head = np.flatnonzero(~same)
        self.start, self.length, self.owner = start[head], length[head].astype(np.int16), owner.astype(np.int32)
        self.first = np.append(head, len(start))

    def by_rarest(self, df) -> None:
        """Order windows by their rarest term, given the numbers of postings of ``terms``; those with a term that never occurs are not kept."""
        import numpy as np

        rarest, least, long = np.zeros(len(self.start), np.int64), np.full(len(self.start), np.iinfo(np.int64).max), self.length.astype(np.int64)
        for j in range(int(long.max(initial=0))):
            own = self.tokens[self.start + np.minimum(j, long - 1)]
            rarest, least = np.where(df[own] < least, own, rarest), np.minimum(df[own], least)
        windows = np.flatnonzero(least > 0)
        self.windows = windows[np.argsort(rarest[windows], kind="stable")]
        self.edges = np.searchsorted(rarest[self.windows], np.arange(len(self.terms) + 1))

    def tried(self, has) -> list[tuple[int, list[int]]]:
        """The windows of which all terms are among those that ``has`` marks, with their tokens, starting from the rarest terms."""
        import numpy as np

        some = np.flatnonzero(has)
        sizes = self.edges[some + 1] - self.edges[some]
        at = np.repeat(self.edges[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        windows = self.windows[at]
        long = self.length[windows].astype(np.int64)
        for j in range(int(long.max(initial=0))):
            ok = has[self.tokens[self.start[windows] + np.minimum(j, long - 1)]]
            windows, long = windows[ok], long[ok]
        return [(w, self.tokens[self.start[w] : self.start[w] + self.length[w]].tolist()) for w in windows.tolist()]

    def owners(self, window: int) -> list[int]:
        return self.owner[self.first[window] : self.first[window + 1]].tolist()


def vocabulary(items: DataFrame) -> DataFrame:
    """(term) of all different words of ``items(text)``."""

    def run(it):
        import pyarrow as pa

        for b in sliced(it):
            yield pa.RecordBatch.from_arrays([pa.array({term_key(w) for t in text_bytes(b.column("text")) for w in words(t)}, pa.int64())], names=["term"])

    return items.select("text").mapInArrow(run, "term long").distinct()


def build_index(docs: DataFrame, terms, gap: int) -> DataFrame:
    """Segments of ``docs(doc_id, text)``: a row for each of the sorted ``terms`` (broadcast) that occurs, and one with the documents themselves (df 0)."""

    def run(it):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        known, part, made = terms.value, TaskContext.get().partitionId(), 0
        held: list = []

        def number(word: bytes) -> int:
            key = term_key(word)
            at = int(known.searchsorted(key))
            return at if at < len(known) and known[at] == key else -1

        numbers = Cache(number, 300_000)

        def segment():
            nonlocal held, made
            lengths = np.array([len(t) for _, t in held], np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1]))
            found = np.concatenate([t for _, t in held])
            places = np.arange(len(found)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
            own = found >= 0
            found, places = found[own], places[own]
            order = np.argsort(found, kind="stable")
            found, places = found[order], places[order].astype(np.int32)
            found, first = np.unique(found, return_index=True)
            lists = np.split(places, first[1:]) if len(found) else []
            ids = np.array([(i or 0, i is not None, s, n) for (i, _), s, n in zip(held, starts.tolist(), lengths.tolist(), strict=True)], _DOC)
            key = (part << 32) | made
            rows = [(key, None, 0, None, ids.tobytes()), *((key, int(t), len(x), x.tobytes(), None) for t, x in zip(known[found].tolist(), lists, strict=True))]
            held, made = [], made + 1
            for k in range(0, len(rows), 20_000):
                cols = zip(*rows[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["segment", "term", "df", "positions", "docs"])

        size = 0
        for b in sliced(it):
            for i, t in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), strict=True):
                own = words(t)
                held.append((i, np.fromiter(map(numbers.__getitem__, own), np.int32, len(own))))
                size += len(own) + gap
                if size >= SEGMENT_TOKENS:
                    yield from segment()
                    size = 0
        if held:
            yield from segment()

    return docs.mapInArrow(run, _INDEX)


_DOC = [("doc", "<i8"), ("known", "u1"), ("start", "<i8"), ("n", "<i8")]


def intersect(lists: list, offsets: list[int]):
    """Places p with p + offset in each list, from the shortest list on."""
    import numpy as np

    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    out = lists[order[0]] - offsets[order[0]]
    for i in order[1:]:
        if not len(out):
            break
        at = np.searchsorted(lists[i], out + offsets[i])
        at[at == len(lists[i])] = 0
        out = out[lists[i][at] == out + offsets[i]]
    return out


def near(lists: list, span: int):
    """First places of spans of at most ``span`` words that hold a word of each list (a list given twice counts twice).

    Around each place of the rarest term, each range is found that ends at a place of some term and is the
    tightest with as many places of each term as it is given times.
    """
    import numpy as np

    if not all(len(x) for x in lists):
        return np.zeros(0, np.int64)
    # a place has one term, so lists with the same first place are of the same term
    terms: dict[int, list] = {}
    for x in lists:
        terms.setdefault(int(x[0]), [x, 0])[1] += 1
    order = sorted(terms.values(), key=lambda t: len(t[0]))
    places = order[0][0]
    for x, times in order:  # those with enough places of each term around them
        places = places[np.searchsorted(x, places + span) - np.searchsorted(x, places - span + 1) >= times]
    found = []
    for p in places.tolist():
        around = sorted((place, k) for k, (x, _) in enumerate(order) for place in x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)].tolist())
        need, missing, first = [times for _, times in order], len(lists), 0
        for high, k in around:
            missing -= need[k] > 0
            need[k] -= 1
            while need[around[first][1]] < 0:  # the first place isn't needed
                need[around[first][1]] += 1
                first += 1
            low = around[first][0]
            if not missing and low <= p <= high and high - low < span:
                found.append(low)
    return np.unique(np.array(found, np.int64))


def _segments(it):
    """(segment, {term: positions}, documents) from batches in which a segment's rows stand together."""
    import numpy as np

    key, lists, docs = None, {}, None
    for b in it:
        for s, term, places, own in zip(*(b.column(c).to_pylist() for c in ("segment", "term", "positions", "docs")), strict=True):
            if s != key and key is not None:
                yield key, lists, docs
                lists, docs = {}, None
            key = s
            if term is None:
                docs = np.frombuffer(own, _DOC)
            else:
                lists[term] = np.frombuffer(places, np.int32)
    if key is not None:
        yield key, lists, docs


def phrase_matches(index: DataFrame, phrases, slop: int | None = None) -> DataFrame:
    """Per document row: doc_id, row (its number, the same for every block), n_words, hits, items, near_items.

    ``hits`` are the places of words inside an exact match. With ``slop``, ``near_items`` are the items of
    which some window's terms stand, in any order, within ``slop`` words more than the window's length.
    """

    def run(it):
        import numpy as np
        import pyarrow as pa

        p = phrases.value
        for key, lists, docs in _segments(it):
            hits: dict[int, list] = {}
            items: dict[int, set] = {}
            close: dict[int, set] = {}
            own_terms = np.array(sorted(lists), np.int64)
            at = np.searchsorted(p.terms, own_terms)
            at = at[(at < len(p.terms)) & (p.terms[np.minimum(at, len(p.terms) - 1)] == own_terms)] if len(p.terms) else at[:0]
            has = np.zeros(len(p.terms), bool)
            has[at] = True
            for window, tokens in p.tried(has):
                own = [lists[t] for t in p.terms[tokens].tolist()]
                at = intersect(own, list(range(len(own))))
                if len(at):
                    for d, place in zip((np.searchsorted(docs["start"], at, "right") - 1).tolist(), at.tolist(), strict=True):
                        hits.setdefault(d, []).append(np.arange(place, place + len(own)) - docs["start"][d])
                        items.setdefault(d, set()).update(p.owners(window))
                if slop is not None:
                    at = near(own, len(own) + slop)
                    for d in np.searchsorted(docs["start"], at, "right") - 1:
                        close.setdefault(int(d), set()).update(p.owners(window))
            ids = lambda x, d: sorted({p.items[k] for k in x.get(d, ())}, key=str)
            for a in range(0, len(docs), 10_000):
                part = range(a, min(a + 10_000, len(docs)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs["doc"][a : a + 10_000], mask=docs["known"][a : a + 10_000] == 0), pa.array([key] * len(part), pa.int64()), pa.array(list(part), pa.int32()), pa.array(docs["n"][a : a + 10_000]), pa.array([np.unique(np.concatenate(hits[d])).astype(np.int32) if d in hits else [] for d in part], pa.list_(pa.int32())), pa.array([ids(items, d) for d in part], pa.list_(pa.string())), pa.array([ids(close, d) for d in part], pa.list_(pa.string()))],
                    names=["doc_id", "segment", "row", "n_words", "hits", "items", "near_items"],
                )

    return index.mapInArrow(run, "doc_id long, segment long, row int, n_words long, hits array<int>, items array<string>, near_items array<string>")


def match_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int | None = None, block_bytes: int = BLOCK_BYTES, most_terms: int = VOCABULARY) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, item_ids, near_item_ids, contaminated."""
    import numpy as np

    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total, terms = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], vocabulary(items).count()
    groups = max(1, -(-terms // most_terms))
    blocks = max(groups, -(-total // block_bytes))
    blocks = -(-blocks // groups)  # of each group
    if groups > 1:  # each group goes over the same rows in the same order
        docs = scratch.save(docs, "documents")
    share = lambda n, k, seed: F.lit(True) if n == 1 else F.pmod(F.xxhash64("item_id", "text", F.lit(seed)), F.lit(n)) == k
    out = None
    for g in range(groups):
        group = items.where(share(groups, g, 1))
        known = np.sort(vocabulary(group).toArrow().column("term").to_numpy())  # about most_terms numbers
        index = scratch.save(build_index(docs, spark.sparkContext.broadcast(known), width + (slop or 0) + 1), f"index{g}")
        df = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each known term
        by = np.argsort(df.column("term").to_numpy())
        with_postings, postings = df.column("term").to_numpy()[by], df.column("df").to_numpy()[by]
        # a segment's rows were written by one task into one file; read them by whole segments
        dealt = index.repartition(F.col("segment")).sortWithinPartitions("segment", "term")
        for k in range(blocks):
            # of bounded size: a share of the benchmark that hashing its rows gives, about block_bytes of text
            phrases = Phrases([tuple(r) for r in group.where(share(blocks, k, 2)).toLocalIterator()], width)
            own = np.zeros(len(phrases.terms), np.int64)
            if len(with_postings):
                at = np.minimum(np.searchsorted(with_postings, phrases.terms), len(with_postings) - 1)
                own = np.where(with_postings[at] == phrases.terms, postings[at], 0)
            phrases.by_rarest(own)
            found = phrase_matches(dealt, spark.sparkContext.broadcast(phrases), slop)
            out = found if out is None else out.union(found)
    if groups * blocks > 1:  # a document's rows of all blocks
        out = out.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near_items")))
    return out.withColumn("n_hit", F.size("hits").cast("long")).select("doc_id", "n_words", "n_hit", F.col("items").alias("item_ids"), F.col("near_items").alias("near_item_ids"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _exact(found: DataFrame, *more) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", *more)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, with the items of which a window's words stand near each other."""
    return _exact(match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP), "near_item_ids")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda j: array_to_string(w[j:j + 12], ' ')) END) AS x, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM i),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS x FROM d, n WHERE len(w) >= n),
m AS (SELECT g.doc_id, g.k, g.n, i.item_id FROM g JOIN i ON g.x = i.x AND g.n = i.n),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> list[tuple]:
    """The contract's rows by trying each window at each place; for tests."""
    out = []
    own = [(i, words((t or "").encode())) for i, t in items]
    for i, t in docs:
        w, hit, names = words((t or "").encode()), set(), set()
        for name, x in own:
            for a in range(max(1, len(x) - width + 1) if x else 0):
                y = x[a : a + width]
                for p in range(len(w) - len(y) + 1):
                    if w[p : p + len(y)] == y:
                        hit |= set(range(p, p + len(y)))
                        names.add(name)
        ids = sorted(str(n) for n in names if n is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
