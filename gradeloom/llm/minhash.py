"""Operator 8: document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once; its high bits name a bin, and each bin keeps its least hash.
Empty bins are filled by optimal densification: each draws a bin at random (by an order of bins that is
its own and the same for all texts) until one that is not empty comes up, and takes over that bin's
value. ``BITS`` low-order bits of each bin's value are stored. Two unequal values agree in them by chance
with probability C = 2**-BITS, so likeness is (share of equal bins - C) / (1 - C), at least 0.

The fingerprint of a text without words is that of no shingle: it is the empty string, alike to itself
(1) and to nothing else (0).

For edited texts each document needs the one that follows in ascending order of ids. Ids are cut into
ranges (from quantiles); the first document of each range is found by its id and added to the range
before it. Then one shuffle by range and a sort inside the tasks let each task go through its ranges
with one document of look-ahead.

Defined cases: null texts are empty; null doc_ids come last in the order; rows that repeat a doc_id
follow in the order of their texts; a single document is followed by itself; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, sliced, table
from .shingles import Shingler

BINS = 512
#: a range is sorted by one task and streamed with one document of look-ahead, so that it may be of any size
MOST_RANGES = 100_000
BITS = 4


class MinHasher:
    """Fingerprints of ``bins`` bins with ``bits`` bits each; bins is a power of two, bits 1, 2, 4 or 8."""

    def __init__(self, bins: int = BINS, bits: int = BITS, k: int = 5, seed: int = 20260101):
        import numpy as np

        self.np, self.bins, self.bits = np, bins, bits
        self.shingler = Shingler(k)
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        rng = np.random.Generator(np.random.PCG64(seed))
        #: ranks[i, j]: when bin i, if it is empty, draws bin j
        self.ranks = np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.uint16)
        self.draws = self.ranks.argsort(axis=1)[:, :8].copy()  # the first bins that each bin draws

    def signature(self, text: bytes):
        """The stored bits of all bins as small integers; none if the text has no word."""
        np = self.np
        hashes = self.shingler.set(text)
        if not len(hashes):
            return np.zeros(0, np.uint8)
        at = (hashes >> self.shift).astype(np.int64)
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        full = at[new]  # the hashes are sorted: the first of each bin is its least
        # the high bits of a minimum are skewed towards 0, the low ones are even
        low = (hashes[new] & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        values = np.zeros(self.bins, np.uint8)
        values[full] = low
        if len(full) < self.bins:
            has = np.zeros(self.bins, bool)
            has[full] = True
            empty = np.flatnonzero(~has)
            if 4 * len(full) > self.bins:  # most find one within their first draws
                draws = self.draws[empty]
                hit = has[draws]
                first = hit.argmax(axis=1)
                found = hit[np.arange(len(empty)), first]
                values[empty[found]] = values[draws[found, first[found]]]
                empty = empty[~found]
            if len(empty):
                values[empty] = low[self.ranks[np.ix_(empty, full)].argmin(axis=1)]
        return values

    def pack(self, signature) -> str:
        """Hexadecimal form of the packed bits."""
        np = self.np
        if not len(signature):
            return ""
        bits = np.unpackbits(signature[:, None], axis=1)[:, 8 - self.bits :]
        return np.packbits(bits.ravel()).tobytes().hex()

    def likeness(self, x, y) -> float:
        """The estimated Jaccard similarity of two texts from their signatures."""
        if not len(x) or not len(y):
            return float(len(x) == len(y))
        chance = 2.0**-self.bits
        return max(0.0, (float((x == y).mean()) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(hasher: MinHasher, doc, text: str, own, following: str, theirs) -> tuple:
    new = edited(text, following)
    raw = new.encode("utf-8", "surrogatepass")
    changed = own if new == text else hasher.signature(raw)
    return doc, len(text), hashlib.sha256(raw).hexdigest(), hasher.pack(own), hasher.pack(changed), hasher.likeness(own, changed), hasher.likeness(own, theirs)


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(…, fingerprint) for every row of ``docs``: packed signatures alone, one pass without a shuffle."""

    @F.pandas_udf("string")
    def sign(texts):
        hasher = held(MinHasher, bins, bits)
        return texts.map(lambda t: hasher.pack(hasher.signature((t or "").encode())))

    return docs.withColumn("fingerprint", sign("text"))


def fingerprint_with_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS, range_rows: int = 1_000) -> DataFrame:
    """Fingerprints of each text of ``docs(doc_id, text)`` and its edited text, and their likeness.

    ``range_rows``: about how many documents a range of ids has. Beyond ``MOST_RANGES`` ranges they have more,
    which bounds the cuts and first ids that the driver holds; results don't depend on the ranges.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(MOST_RANGES, max(1, docs.count() // range_rows))
    # a number for each range
    cuts = sorted({int(x) for x in docs.stat.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []

    @F.pandas_udf("int")
    def range_of(ids):
        import numpy as np

        out = np.searchsorted(cuts, ids.to_numpy(float, na_value=np.inf), side="right")
        return ids.__class__(np.where(ids.isna(), len(cuts) + 1, out))

    dealt = docs.withColumn("range", range_of("doc_id"))
    firsts = docs.select("doc_id").withColumn("range", range_of("doc_id")).groupBy("range").agg(F.min("doc_id").alias("doc_id")).orderBy("range").collect()
    if not firsts:
        return spark.createDataFrame([], _OUT)
    before = [(firsts[k - 1]["range"] if k else firsts[-1]["range"], r["doc_id"]) for k, r in enumerate(firsts)]
    # one row for each range, of 12 bytes: a size that the number of ranges bounds
    heads = spark.createDataFrame(before, "to int, head long")
    first_text = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("to").agg(F.min("text").alias("text"))
    rows = dealt.select("range", F.lit(0).alias("ahead"), "doc_id", "text").union(first_text.select(F.col("to").alias("range"), F.lit(1), F.lit(None).cast("long"), "text"))
    rows = rows.repartition(F.col("range")).sortWithinPartitions("range", "ahead", F.asc_nulls_last("doc_id"), "text")
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(it):
        import pyarrow as pa

        hasher = held(MinHasher, bins, bits)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        last = None
        for b in sliced(it):
            out = []
            for ahead, doc, text in zip(*(b.column(c).to_pylist() for c in ("ahead", "doc_id", "text")), strict=True):
                own = hasher.signature(text.encode())
                if last is not None:
                    out.append(_row(hasher, *last, text, own))
                last = None if ahead else (doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.select("ahead", "doc_id", "text").mapInArrow(run, _OUT)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, sf_dir, "documents"))
