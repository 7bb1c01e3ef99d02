"""Operator 4: best-fit packing of token sequences, hierarchical over residual bins.

Each task cuts its documents into pieces of at most ``capacity`` tokens and packs them best-fit,
largest first, in blocks of bounded size. Nearly full bins are final at once. The others become items
of the next round, in which fewer tasks pack them best-fit again; rounds repeat until one task holds
all that is left or a round merges nothing. A bin travels as one row with its members packed in
one binary field, so no text or token moves and no join is needed to find places in the end.

Defined cases: a null or empty text is the single separator token; a null doc_id stays null; rows that
repeat are packed each for itself; ties go to the bin made first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, Scratch, held, quiet_workers, sliced, spread, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: words that a worker keeps encoded, up to twice as many: a bound of its memory, which changes no result
WORD_CACHE = 1_000_000
_MEMBER = [("doc", "<i8"), ("known", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")]
_BIN = "bin long, fill int, final boolean, members binary"
_BLOCK_BYTES = 128 << 20
_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordEncoder:
    """Token ids as little-endian bytes; words between blanks are encoded once while they are cached.

    The vocabulary's rules never join anything across a space or line feed, so a text's ids are those
    of its words, one after the other.
    """

    def __init__(self, path: str, most: int = WORD_CACHE):
        quiet_workers()
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.array = np.array
        self.words = Cache(self._encode, most)

    def _encode(self, word: str) -> bytes:
        return self.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``, best-fit with the largest first.

    Free space is at most ``capacity``, so open bins stand in one stack for each amount, and the bits
    of one integer say which stacks have any: finding the tightest bin is one shift.
    """
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        if above := free >> n:
            room = n + (above & -above).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                free &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        if room > n:
            stacks[room - n].append(at)
            free |= 1 << (room - n)
    return bins


def _packed(items: Iterator[tuple[int, bytes]], level: int, capacity: int, nearly: int, block: int, last: bool):
    """Bin rows for (size, members) items, in blocks of bounded size."""
    import pyarrow as pa
    from pyspark import TaskContext

    base, made = (level << 56) | (TaskContext.get().partitionId() << 32), 0

    def emit(held):
        nonlocal made
        rows = []
        for b in best_fit([n for n, _ in held], capacity):
            fill = sum(held[i][0] for i in b)
            rows.append((base | made, fill, last or fill >= nearly, b"".join(held[i][1] for i in b)))
            made += 1
        for k in range(0, len(rows), 5_000):
            cols = list(zip(*rows[k : k + 5_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bin", "fill", "final", "members"])

    held: list[tuple[int, bytes]] = []
    size = 0
    for x in items:
        held.append(x)
        size += len(x[1])
        if len(held) >= block or size >= _BLOCK_BYTES:
            yield from emit(held)
            held, size = [], 0
    if held:
        yield from emit(held)


def _left(bins: DataFrame) -> tuple[int, int]:
    """How many bins are not final, and the bytes of their members."""
    return tuple(bins.where("not final").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("members")), F.lit(0))).first())


def pack(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, nearly_full: float = 0.998, block: int = 100_000, vocabulary: str | None = None, word_cache: int = WORD_CACHE) -> DataFrame:
    """Pack the texts of ``docs(doc_id, text)``; one row per piece with its sequence and offset.

    ``block`` bounds the items that one task packs at once, ``nearly_full`` the share of the capacity
    from which a bin is final in its first rounds.
    """
    path, nearly = tokenizer_path(VOCABULARY, vocabulary), int(nearly_full * capacity)
    scratch = Scratch(docs.sparkSession, "packing")

    def pieces(it):
        import numpy as np

        encoder, end = held(WordEncoder, path, word_cache), np.array([separator], "<u4").tobytes()
        for b in sliced(it):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    yield len(own) // 4, np.array([(doc or 0, doc is not None, k, at // 4, len(own) // 4, zlib.crc32(own))], _MEMBER).tobytes()

    def first(it):
        yield from _packed(pieces(it), 0, capacity, nearly, block, False)

    done: list[DataFrame] = []
    bins = scratch.save(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(first, _BIN), "bins0")
    left, size, level = *_left(bins), 0
    while True:
        done.append(bins.where("final"))
        if not left:
            break
        level += 1
        groups = max(-(-left // block), -(-size // _BLOCK_BYTES))

        def again(it, level=level, last=groups == 1):
            rows = ((n, m) for b in it for n, m in zip(b.column("fill").to_pylist(), b.column("members").to_pylist(), strict=True))
            yield from _packed(rows, level, capacity, nearly, block, last)

        rest = bins.where("not final").drop("final")
        dealt = rest.coalesce(1) if groups == 1 else rest.repartition(groups, F.xxhash64("bin", F.lit(level)))
        bins = scratch.save(dealt.mapInArrow(again, _BIN), f"bins{level}")
        before, (left, size) = left, _left(bins)
        if left >= before:  # nothing fits into anything any more
            done.append(bins)
            break

    def places(it):
        import numpy as np
        import pyarrow as pa

        for b in it:
            parts = [np.frombuffer(m, _MEMBER) for m in b.column("members").to_pylist()]
            if not parts:
                continue
            rows, counts = np.concatenate(parts), np.array([len(p) for p in parts])
            ends = np.cumsum(rows["length"].astype("i8"))
            firsts = np.cumsum(counts) - counts
            begin = (ends - rows["length"])[firsts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc"], mask=rows["known"] == 0), pa.array(rows["piece"]), pa.array(rows["start"]), pa.array(rows["length"].astype("i8")), pa.array(rows["crc"].astype("i8")), pa.array(np.repeat(np.array(b.column("bin").to_pylist(), "i8"), counts)), pa.array(ends - rows["length"] - np.repeat(begin, counts))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("bin", "members").mapInArrow(places, _OUT)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
