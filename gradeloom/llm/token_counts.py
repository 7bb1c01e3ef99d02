"""Operator 7: exact token counts at every prefix, by dynamic programming over prefixes.

A byte-pair encoding has this property: a sequence of tokens is the encoding of its text exactly if
each pair of neighbours is the encoding of the pair's own text. So the encoding of a prefix that ends
at ``i`` is that of some shorter prefix plus one token ``t`` that ends at ``i``, where ``t`` may
follow the shorter prefix's last token; exactly one ``t`` does. One table entry (count, last token)
for each prefix gives the next ones, and no prefix is encoded again.

No vocabulary entry has the word mark after another character, so encodings never cross the start of
a word: tables are made once for each distinct word and joined.

Defined cases: a null or empty text has no tokens; text of any length is counted whole; rows that
repeat are counted each for itself; any other columns are left out unless named in ``keep``, and kept columns
with the name of a result are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, held, refuse_clashes, sliced, spread, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"


class PrefixCounter:
    """Token counts of every prefix of a text, for a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str, most: int = 1_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        skip = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not any(f(i) for f in skip)}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.scores):
            raise ValueError("this vocabulary has tokens that cross the start of a word")
        #: by last character, the lengths of tokens that are their own encoding
        self.tokens = {t for t in self.scores if len(t) > 1 and self._merge(t) == [t]}
        self.lengths: dict[str, list[int]] = {}
        for c, n in sorted({(t[-1], len(t)) for t in self.tokens}):
            self.lengths.setdefault(c, []).append(n)
        self.follows = Cache(lambda ab: self._merge(ab[0] + ab[1]) == [*ab], most)
        self.words = Cache(self._deltas, most)

    def _merge(self, text: str) -> list[str]:
        """The encoding of a short text, by merging its best pair again and again."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def word_counts(self, word: str) -> list[int]:
        """Counts at the prefixes of a word (its marks included), from length 0 on."""
        counts, last, tokens, follows = [0], [""], self.tokens, self.follows
        for i in range(1, len(word) + 1):
            end = word[i - 1]
            for n in self.lengths.get(end, ()):
                if n > i:
                    token = end
                    break
                token = word[i - n : i]
                if token in tokens and (i == n or follows[last[i - n], token]):
                    break
            else:
                token = end
            if token is end:  # one character, of one token if it is known and of its bytes otherwise
                counts.append(counts[i - 1] + (1 if end in self.scores else len(end.encode())))
            else:
                counts.append(counts[i - n] + 1)
            last.append(token)
        return counts

    def _deltas(self, word: str) -> bytes:
        import numpy as np

        return np.diff(np.array(self.word_counts(word), "<i4")).astype("<i2").tobytes()

    def deltas(self, text: str):
        """For each code point of ``text``, by how much the count of the prefix that it ends differs from the one before.

        Their sum is the whole text's count, the running sum the count at each prefix.
        """
        import numpy as np

        if not text:
            return np.zeros(0, "<i2")
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or marked[-1] == MARK:
            words = re.findall(f"{MARK}+[^{MARK}]*", marked)
        else:
            words = [MARK + w for w in marked.split(MARK)[1:]]
        out = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i2")
        # the mark before the text belongs to its first prefix
        return np.concatenate(([out[0] + out[1]], out[2:])).astype("<i2")


def pack_deltas(deltas) -> bytes:
    """A compact form of :meth:`PrefixCounter.deltas`: the item size, then the compressed items."""
    small = not len(deltas) or abs(deltas.astype(int)).max() < 128
    return bytes([1 if small else 2]) + zlib.compress(deltas.astype("<i1" if small else "<i2").tobytes(), 1)


def prefix_counts(packed: bytes):
    """Counts at all prefixes from length 0 on, from the stored form."""
    import numpy as np

    items = np.frombuffer(zlib.decompress(packed[1:]), f"<i{packed[0]}")
    return np.concatenate(([0], np.cumsum(items, dtype="i8")))


def longest_within(packed: bytes, budget: int) -> int:
    """Length in code points of the longest prefix of at most ``budget`` tokens."""
    import numpy as np

    return int(np.flatnonzero(prefix_counts(packed) <= budget)[-1]) if budget >= 0 else 0


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model_file: str | None = None) -> DataFrame:
    """Per row of ``docs``: the kept columns, ``n_bytes``, ``n_tokens`` and ``prefix_table`` (binary).

    One pass without a shuffle; a task holds one Arrow batch and a bounded cache of words.
    """
    refuse_clashes(keep, ("n_bytes", "n_tokens", "prefix_table"))
    path = tokenizer_path(MODEL, model_file)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("prefix_table", T.BinaryType())])

    def run(it: Iterator):
        import pyarrow as pa

        counter = held(PrefixCounter, path)
        for b in sliced(it):
            n_bytes, n_tokens, tables = [], [], []
            for t in b.column(text).to_pylist():
                deltas = counter.deltas(t or "")
                n_bytes.append(len((t or "").encode()))
                n_tokens.append(int(deltas.sum(dtype="i8")))
                tables.append(pack_deltas(deltas))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(tables, pa.binary())], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def truncate_to_budget(counted: DataFrame, budget: int, text: str = "text", prefix_table: str = "prefix_table") -> DataFrame:
    """Cut each text to its longest prefix of at most ``budget`` tokens, by the stored counts alone."""

    @F.pandas_udf(T.IntegerType())
    def fits(tables):
        return tables.map(lambda x: longest_within(bytes(x), budget))

    return counted.withColumn(text, F.left(F.col(text), fits(prefix_table)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(spread(table(spark, sf_dir, "documents")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "prefix_table")
