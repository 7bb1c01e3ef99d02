"""Operator 11: packing by minimum bin slack over the multiset of lengths.

Documents become token ids and are cut into items of at most ``capacity`` tokens. Which items share a window
depends on their lengths alone, and there are at most ``capacity`` different ones: their counts are the whole
problem, whatever the number of documents. The largest length left opens a window; a subset-sum over the
multiset of the others (a bitset of reachable fills for each length, shifted by copies in powers of two) finds
the fill closest to capacity; backtracking through the bitsets gives how many of each length it takes, with few
small ones. The pattern is used for as many windows as the counts allow, which ends one length's supply, so that
the number of patterns is bounded by the capacity and not by the documents.

Where even the best fill leaves slack, the largest item left is cut to close it, and its rest returns to the
multiset. What is left in the end, less than a window, fills windows of sizes that are powers of two, which need
no padding: no sequence has any.

Items are numbered inside their length by (task, place in the task); the tasks' counts, summed up, give every
item its number among all of its length. A table of number ranges, with a row for each use of a length in a
pattern, then tells each item its windows; it is the same size for any number of documents and is broadcast.
Only rows of a few numbers are shuffled. The texts of cut items are encoded once more for the checksums of
their parts; other items are encoded once.

Defined cases: a null or empty text is the single separator token; a null doc_id stays null; rows that repeat
are packed each for itself; among items of one length those of earlier tasks come first; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, held, quiet_workers, sliced, spread, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
#: chunks that a worker keeps encoded, up to twice as many: a bound of its memory, which changes no result
CHUNK_CACHE = 600_000
#: names of documents with cut items are broadcast up to so many (a number of at most 20 digits each), joined beyond
MOST_NAMES = 100_000


_MARKS = frozenset(".,;:!?")


class ChunkEncoder:
    """Ids of whole texts as little-endian bytes, from chunks that are encoded once while they are cached.

    The vocabulary's pattern starts a token at each white space that follows anything else, and never joins a
    letter with one of ``.,;:!?``; so a text may be cut before blanks and line feeds that follow no white space,
    and a chunk before its last mark.
    """

    def __init__(self, path: str, most: int = CHUNK_CACHE):
        quiet_workers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.known, self.old = most, {}, {}
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.cut = re.compile(r"(?<=\S)(?=[ \n])").split

    def keys(self, text: str) -> list[str]:
        """Chunks, which start with a blank unless they start with a line feed, or with a mark (a carriage return) in its place."""
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts[1:] or "\n" in parts or not text.replace("\n", " ").isprintable():
            return ["\r" + c for c in self.cut(text)]
        parts[0] = "\r" + parts[0]
        return parts

    def _learn(self, keys: set[str]) -> None:
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        import numpy as np

        known, old = self.known, self.old
        new, marked = [], []
        for k in keys.difference(known):
            if k in old:
                known[k] = old[k]
            elif k[-1:] in _MARKS and len(k) > 2 and k[-2].isalpha():
                marked.append(k)
                new += k[:-1], "\r" + k[-1]
            else:
                new.append(k)
        asked = set(new).difference(known)
        # nothing joins a letter with a line feed, nor a line feed with a blank before a word
        lines = [k for k in asked if k[0] not in "\r\n" and k[-1].isalpha()]
        found = self._lines(lines)
        if found:
            known.update(zip(lines, found, strict=True))
            asked = asked.difference(lines)
        asked = [*asked]
        raw = [k[1:] if k[:1] == "\r" else k if k[:1] == "\n" else " " + k for k in asked]
        for k, e in zip(asked, self.tokenizer.encode_batch_fast(raw, add_special_tokens=False), strict=True):
            known[k] = np.array(e.ids, "<u4").tobytes()
        for k in marked:
            known[k] = known[k[:-1]] + known["\r" + k[-1]]

    def _lines(self, keys: list[str]) -> list[bytes]:
        """Ids of words, each after a blank, from one text with a word in a line; none if its lines can't be told by their ends."""
        import numpy as np

        if not keys or self.feed is None:
            return []
        (whole,) = self.tokenizer.encode_batch_fast(["".join(f" {k}\n" for k in keys)], add_special_tokens=False)
        ids = np.array(whole.ids, "<u4")
        ends = np.flatnonzero(ids == self.feed)
        if len(ends) != len(keys):
            return []
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self.keys(t) for t in texts]
        self._learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, keys)) for keys in split]


def closest_fill(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many of each length fill a window closest to ``capacity``: the largest that fits, and the best of the others with it.

    ``lengths`` are those with a count, ascending.
    """
    fits = bisect_left(lengths, capacity + 1)
    if not fits:
        return {}
    taken = {lengths[fits - 1]: 1}
    room = capacity - lengths[fits - 1]
    within, reached, stages = (1 << room + 1) - 1, 1, []
    for n in reversed(lengths[: bisect_left(lengths, room + 1)]):
        stages.append((n, reached))
        left, copies = min(counts[n] - taken.get(n, 0), room // n), 1
        while left > 0:  # copies in powers of two, the last step what is left of them
            step = min(copies, left)
            reached |= reached << step * n & within
            left, copies = left - step, 2 * copies
        if reached >> room & 1:
            break
    fill = reached.bit_length() - 1
    for n, before in reversed(stages):  # the fewest of the smaller lengths that leave a fill of the larger ones
        k = 0
        while not before >> fill - k * n & 1:
            k += 1
        if k:
            taken[n] = taken.get(n, 0) + k
            fill -= k * n
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Where all items go, from their counts by length; and how many windows there are.

    A row (origin, first, n, start, length, window, turn, copies, offset) says: of the items that had length
    ``origin``, the n numbers from ``first`` on give the ``length`` tokens from ``start``. They fill the
    windows from ``window`` on, ``copies`` in each (of which ``turn`` are taken already), from ``offset`` on.
    """
    counts = {n: c for n, c in histogram.items() if c}
    supply = {n: deque([(n, 0, c, 0)]) for n, c in counts.items()}
    total, windows, rows = sum(n * c for n, c in counts.items()), 0, []

    def take(length: int, n: int, cut: int, window: int, copies: int, offset: int) -> list[tuple]:
        """Use n items of a length, of which ``cut`` tokens go to windows; what is left of them."""
        counts[length] -= n
        turn, rest = 0, []
        while n:
            origin, first, have, start = supply[length].popleft()
            own = min(n, have)
            if own < have:
                supply[length].appendleft((origin, first + own, have - own, start))
            rows.append((origin, first, own, start, cut, window, turn, copies, offset))
            rest.append((origin, first, own, start + cut))
            turn, n = turn + own, n - own
        if not counts[length]:
            del counts[length]
        return rest

    while total:
        size = capacity if total >= capacity else 1 << total.bit_length() - 1
        lengths = sorted(counts)
        pattern = closest_fill(counts, lengths, size)
        slack = size - sum(n * c for n, c in pattern.items())
        # whatever is left besides the pattern is longer than the slack, or it would be in it
        longest = max(n for n in lengths if counts[n] > pattern.get(n, 0)) if slack else 0
        times = min(counts[n] // (pattern.get(n, 0) + (n == longest)) for n in {*pattern, *([longest] if slack else [])})
        times = min(times, total // size) if size == capacity else 1
        offset = 0
        for n, c in pattern.items():
            take(n, c * times, n, windows, c, offset)
            offset += c * n
        if slack:
            rest = take(longest, times, slack, windows, 1, offset)
            supply.setdefault(longest - slack, deque()).extend(rest)
            counts[longest - slack] = counts.get(longest - slack, 0) + times
        windows += times
        total -= size * times
    return rows, windows


def _lookup(rows: list[tuple]):
    """``plan``'s rows for :func:`_placed`: ranges of (origin, number) between the rows' ends, each with its rows."""
    import numpy as np

    table_ = np.array(rows, "i8").reshape(-1, 9)
    by_origin: dict[int, list] = {}
    for k, r in enumerate(rows):
        by_origin.setdefault(r[0], []).append(k)
    origins, starts, lists = [], [], []
    for origin in sorted(by_origin):
        ends = sorted({x for k in by_origin[origin] for x in (rows[k][1], rows[k][1] + rows[k][2])})
        own: list[list[int]] = [[] for _ in ends]
        for k in by_origin[origin]:
            for at in range(bisect_left(ends, rows[k][1]), bisect_left(ends, rows[k][1] + rows[k][2])):
                own[at].append(k)
        origins += [origin] * len(ends)
        starts += ends
        lists += own
    sizes = np.array([len(x) for x in lists], "i8")
    return table_, np.array(origins, "i8"), np.array(starts, "i8"), np.cumsum(sizes) - sizes, sizes, np.array([k for x in lists for k in x], "i8")


_ITEM = "part int, place long, doc_id long, doc_tokens long, item_start long, origin int, crc long"
_PLACED = "doc_id long, doc_tokens long, item_start long, origin int, crc long, cut_from long, length long, sequence_id long, offset long"


def _items(encoder: ChunkEncoder, b, end: bytes, capacity: int):
    """(doc_id, ids, start, bytes) of each item of a batch."""
    for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.ids([t or "" for t in b.column("text").to_pylist()]), strict=True):
        ids += end
        for at in range(0, len(ids), 4 * capacity):
            yield doc, len(ids) // 4, at // 4, ids[at : at + 4 * capacity]


def pack_min_slack(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, vocabulary: str | None = None, chunk_cache: int = CHUNK_CACHE) -> DataFrame:
    """Pack the texts of ``docs(doc_id, text)``: a row for each piece, with its sequence and offset."""
    import numpy as np

    path, spark = tokenizer_path(VOCABULARY, vocabulary), docs.sparkSession
    scratch, end = Scratch(spark, "bin_slack"), np.array([separator], "<u4").tobytes()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encode(it):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, seen = held(ChunkEncoder, path, chunk_cache), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in sliced(it, 300):
            out = []
            for doc, tokens, start, own in _items(encoder, b, end, capacity):
                n = len(own) // 4
                out.append((part, seen[n], doc, tokens, start, n, zlib.crc32(own)))
                seen[n] += 1
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _ITEM.split(", ")])

    items = scratch.save(spread(docs).mapInArrow(encode, _ITEM), "items")
    sizes = items.groupBy("origin", "part").agg(F.count("*").alias("n"))
    sizes = scratch.save(sizes.select("origin", "part", "n", (F.sum("n").over(Window.partitionBy("origin").orderBy("part")) - F.col("n")).alias("lower")), "sizes")
    rows, _ = plan({r["origin"]: r["n"] for r in sizes.groupBy("origin").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most ``capacity`` rows
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    shared = spark.sparkContext.broadcast(_lookup(rows))

    def place(it):
        import numpy as np
        import pyarrow as pa

        table_, origins, starts, firsts, counts, lists = shared.value
        heads = {o: (np.searchsorted(origins, o), np.searchsorted(origins, o, side="right")) for o in set(origins.tolist())}
        for b in it:
            origin, number = (b.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("origin", "number"))
            at = np.empty(len(origin), "i8")
            for o in set(origin.tolist()):
                low, high = heads[o]
                own = origin == o
                at[own] = low + np.searchsorted(starts[low:high], number[own], side="right") - 1
            n = counts[at]
            item = np.repeat(np.arange(len(at)), n)
            row = table_[lists[np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + firsts[at][item]]]
            turn = row[:, 6] + number[item] - row[:, 1]
            kept = [b.column(c).take(pa.array(item)) for c in ("doc_id", "doc_tokens", "item_start", "origin", "crc")]
            new = (row[:, 3], row[:, 4], row[:, 5] + turn // row[:, 7], row[:, 8] + turn % row[:, 7] * row[:, 4])
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, new)], names=[x.split()[0] for x in _PLACED.split(", ")])

    numbered = items.join(sizes.drop("n"), ["origin", "part"]).withColumn("number", F.col("place") + F.col("lower"))
    placed = numbered.select("doc_id", "doc_tokens", "item_start", "origin", "crc", "number").mapInArrow(place, _PLACED)
    if all(r[4] == r[0] for r in rows):
        return _pieces(placed, F.col("crc"))
    placed = scratch.save(placed, "placed")
    few = sum(r[2] for r in rows if r[4] < r[0]) <= MOST_NAMES
    return _pieces(placed.where("length = origin"), F.col("crc")).union(_pieces(_parts(docs, placed.where("length < origin"), end, capacity, path, chunk_cache, few), F.col("part_crc")))


def _pieces(placed: DataFrame, crc) -> DataFrame:
    return placed.select("doc_id", (F.col("item_start") + F.col("cut_from")).alias("start"), "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _parts(docs: DataFrame, cut: DataFrame, end: bytes, capacity: int, path: str, chunk_cache: int, few: bool) -> DataFrame:
    """Placed parts of cut items with ``part_crc``: their documents are encoded again, found by a broadcast of their names if these are few.

    An item is known by document, place, size and checksum, so that rows that repeat an id are told apart unless
    their items are equal, and then so are their parts.
    """
    item = ["doc_id", "doc_tokens", "item_start", "origin", "crc"]
    # null ids are equal here, and no id has the name of the null
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def encode(it):
        import pyarrow as pa

        encoder = held(ChunkEncoder, path, chunk_cache)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for b in sliced(it, 300):
            out = [("" if doc is None else str(doc), tokens, start, len(own) // 4, zlib.crc32(own), own) for doc, tokens, start, own in _items(encoder, b, end, capacity)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["name", *item[1:], "ids"])

    asked = cut.withColumn("name", name)
    names = asked.select("name").distinct()
    again = docs.withColumn("name", name).join(F.broadcast(names) if few else names, "name", "left_semi").select("doc_id", "text")
    ids = again.mapInArrow(encode, "name string, doc_tokens long, item_start long, origin int, crc long, ids binary")
    wanted = ids.join(asked.select("name", *item[1:]).distinct(), ["name", *item[1:]], "left_semi").dropDuplicates(["name", *item[1:]])
    both = asked.join(wanted, ["name", *item[1:]])
    own = F.substring("ids", 4 * F.col("cut_from") + 1, 4 * F.col("length"))
    return both.withColumn("part_crc", F.crc32(own)).drop("name", "ids")


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_min_slack(table(spark, sf_dir, "documents"))
