"""Operator 5: toxicity by two class-conditional Kneser-Ney models over the characters of words.

A word (a run of word characters, in lower case) is spelled out from the blank before it to the blank after
it. Each symbol x follows a context h of up to ``ORDER - 1`` symbols, never from before the word's blank, and
h' is h without its first symbol. With C the number of times that a sequence occurs (at lower orders, unless
it begins a word: the number of different symbols before it, Kneser-Ney's continuation count), T(h) and N(h)
the sum and the number of the counts after h, and a discount d = n1 / (n1 + 2 n2) for each order from how many
counts are one and two, the shared model over both classes' counts is

    p(x | h)   = (max(C(h x) - d, 0) + d N(h) p(x | h')) / T(h)

and a class backs off to its own lower order, and to the shared model with the weight of ``PRIOR`` symbols:

    p_c(x | h) = (max(C_c(h x) - d_c, 0) + d_c N_c(h) p_c(x | h') + PRIOR p(x | h)) / (T_c(h) + PRIOR)

Single symbols are shared. All of these sum to one over x. An inflected word that no labelled document has is
known by its stem; what is rare in a class has nearly the shared probability in both.

A toxic document is mostly ordinary words, so of its words only the share ``SHARE`` is drawn from the toxic
model. A document's value is the log-likelihood of its words as a toxic document, less that as an ordinary
one, by their number (plus ``STEADY``, that very short texts do not stand out by chance):

    sum over words of log(1 - SHARE + SHARE p_1(w) / p_0(w)) / (words + STEADY)

Counts come from the labelled documents of all learning folds but one, which only sets the threshold. Whole
sequences are the keys of ordinary tables, which grow with the corpus; orders are joined natively. The tables
hold the sequences of all documents (with counts of 0 for those without labels), so each has its value.
Values of up to ``MOST_HELD`` sequences (by count, 24 MB) are broadcast; beyond that each chunk of documents
asks ranges of them for the values of its own, with the same results.

Defined cases: null and empty texts and those without a word have value 0; labels that repeat a doc_id count
as the greatest of them; null labels do not count; without labels of both classes all scores are 0; rows that
repeat are scored each for itself; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold_id, sliced, spread, table

ORDER = 6
PRIOR = 20
SHARE = 0.01
STEADY = 20
#: so many sequences' values (of 12 bytes) are broadcast
MOST_HELD = 2_000_000
_SPLIT = re.compile(r"\w+")
_BINS = 8192
_LAST = 2**31 - 1


def words_of(text: str | None) -> list[str]:
    return _SPLIT.findall(text.lower()) if text else []


def _mixed(h):
    """64-bit numbers, mixed so that their upper bits are even."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def spelled(words: list[str], order: int):
    """For each symbol of the words: the key of the sequence that it ends, its word's number, and where the sequence starts and ends in the text that is returned."""
    import numpy as np

    if not words:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, ""
    text = f" {' '.join(words)} "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = points == 32
    place = np.arange(len(points))
    start = np.maximum.accumulate(np.where(blank, place, 0))[:-1]  # of the word that each symbol but the first belongs to
    depth = place[1:] - start
    keys = np.zeros(len(depth), np.uint64)
    for back in range(order - 1, -1, -1):
        far = np.concatenate((np.zeros(min(back - 1, len(depth)), np.uint64), points[: max(0, len(points) - back)])) if back else points[1:]
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + np.where(back <= depth, far, 0)
    return _mixed(keys), np.cumsum(blank)[:-1] - 1, place[1:] - np.minimum(depth, order - 1), place[1:] + 1, text


def key_of(sequence: str) -> int:
    """The key of one sequence, as :func:`spelled` gives it."""
    h = 0
    for c in sequence:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & (2**64 - 1)
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & (2**64 - 1)
    return h ^ (h >> 32)


def _counts(rows: DataFrame, order: int, most_words: int = 300_000) -> DataFrame:
    """(g, c0, c1): the longest sequence that ends at each symbol of ``rows(text, toxic)``, and how often it occurs in the classes; parts of the sums."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        found: tuple[Counter, Counter] = (Counter(), Counter())
        plain: set[str] = set()

        def flush():
            words = list(plain.union(*found))
            keys, word, start, end, text = spelled(words, order)
            distinct, first, where = np.unique(keys, return_index=True, return_inverse=True)
            sums = [np.bincount(where, weights=np.array([c[w] for w in words], float)[word], minlength=len(distinct)).astype(np.int64) for c in found]
            for a in range(0, len(first), 50_000):
                own = first[a : a + 50_000]
                g = [text[i:j] for i, j in zip(start[own].tolist(), end[own].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), *(pa.array(s[a : a + 50_000]) for s in sums)], names=["g", "c0", "c1"])
            plain.clear()
            for c in found:
                c.clear()

        for b in sliced(it):
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                (plain if toxic is None else found[toxic]).update(words_of(text))
            if len(plain) + len(found[0]) + len(found[1]) >= most_words:
                yield from flush()
        if plain or found[0] or found[1]:
            yield from flush()

    return rows.mapInArrow(run, "g string, c0 long, c1 long")


def _discount(once: int, twice: int) -> float:
    """The absolute discount n1 / (n1 + 2 n2), from how many counts are one and two."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def sequence_values(top: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(g, p0, p1, p) for each sequence of ``top(g, c0, c1)``: probabilities of its last symbol after the others, in the classes and shared."""
    names = ("c0", "c1", "c")
    top = top.withColumn("c", F.col("c0") + F.col("c1"))
    # counts of all orders: of each different ending of two symbols or more, whether a class has it, counted for what follows its first symbol
    endings = top.select(F.explode(F.transform(F.sequence(F.lit(2), F.char_length("g")), lambda n: F.right(F.col("g"), n))).alias("x"), *names)
    endings = endings.groupBy("x").agg(*(F.max(F.col(c) > 0).alias(c) for c in names))
    lower = endings.groupBy(F.expr("substring(x, 2)").alias("g")).agg(*(F.count_if(c).alias(c) for c in names))
    whole = (F.char_length("g") == order) | F.startswith(F.col("g"), F.lit(" "))
    counts = scratch.save(lower.union(top.where(whole).select("g", *names)), "counts")
    stats = {r["n"]: r for r in counts.groupBy(F.char_length("g").alias("n")).agg(*(f(c) for c in names for f in (lambda c: F.count_if(F.col(c) == 1).alias(f"once_{c}"), lambda c: F.count_if(F.col(c) == 2).alias(f"twice_{c}"))), F.sum("c").alias("total"), F.count_if(F.col("c") > 0).alias("some"), F.count("*").alias("size")).collect()}  # a row for each order

    def discount(c):
        out = F.lit(0.5)
        for n, r in stats.items():
            out = F.when(F.char_length("g") == n, F.lit(_discount(r[f"once_{c}"], r[f"twice_{c}"]))).otherwise(out)
        return out

    # p = a + b * lower p, and p_k = a_k + b_k * lower p_k + e_k * p
    sums = counts.where("char_length(g) > 1").groupBy(F.expr("left(g, char_length(g) - 1)").alias("h")).agg(*(F.sum(c).alias(f"t_{c}") for c in names), *(F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in names))
    own = counts.where("char_length(g) > 1").withColumns({"h": F.expr("left(g, char_length(g) - 1)"), **{f"d_{c}": discount(c) for c in names}}).join(sums, "h")
    kept, open_ = (lambda c: F.greatest(F.col(c) - F.col(f"d_{c}"), F.lit(0.0))), (lambda c: F.col(f"d_{c}") * F.col(f"n_{c}"))
    terms = own.select("g", F.when(F.col("t_c") > 0, kept("c") / F.col("t_c")).otherwise(0.0).alias("a"), F.when(F.col("t_c") > 0, open_("c") / F.col("t_c")).otherwise(1.0).alias("b"), *(x for k in ("0", "1") for x in ((kept(f"c{k}") / (F.col(f"t_c{k}") + PRIOR)).alias(f"a{k}"), (open_(f"c{k}") / (F.col(f"t_c{k}") + PRIOR)).alias(f"b{k}"), (PRIOR / (F.col(f"t_c{k}") + PRIOR)).alias(f"e{k}"))))
    terms = scratch.save(terms, "terms")
    one, d = stats[1], _discount(stats[1]["once_c"], stats[1]["twice_c"])
    single = counts.where("char_length(g) = 1").select(F.col("g").alias("s"), ((F.greatest(F.col("c") - d, F.lit(0.0)) + d * one["some"] / one["size"]) / max(one["total"], 1)).alias("p"))
    out = top.select("g", F.expr("right(g, 1)").alias("s")).join(single, "s").select("g", *(F.col("p").alias(x) for x in ("p0", "p1", "p")))
    for n in range(2, order + 1):
        own = terms.where(F.char_length("g") == n).withColumnRenamed("g", "s")
        at = out.withColumn("s", F.when(F.char_length("g") >= n, F.expr(f"right(g, {n})")))
        p = F.col("a") + F.col("b") * F.col("p")
        met = at.join(own, "s", "left")
        out = met.select("g", *(F.when(F.col("a").isNull(), F.col(f"p{k}")).otherwise(F.col(f"a{k}") + F.col(f"b{k}") * F.col(f"p{k}") + F.col(f"e{k}") * p).alias(f"p{k}") for k in ("0", "1")), F.when(F.col("a").isNull(), F.col("p")).otherwise(p).alias("p"))
    return out


def _keyed(values: DataFrame, bits: int = 0) -> DataFrame:
    """(part, key, value) of (g, value); ``part`` is the range of keys."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        for b in it:
            keys = np.array([key_of(g) for g in b.column("g").to_pylist()], np.uint64)
            part = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys.view(np.int64)), b.column("value").cast(pa.float32())], names=["part", "key", "value"])

    return values.mapInArrow(run, "part int, key long, value float")


def word_values(sums, share: float = SHARE):
    """log(1 - share + share * exp(sum)) of the words' log-ratios."""
    import numpy as np

    return np.logaddexp(math.log1p(-share), math.log(share) + sums)


class _Words(dict):
    """Values of words by a table of all sequences' values; it starts anew beyond ``most`` words."""

    def __init__(self, keys, values, order: int, most: int = 500_000):
        import numpy as np

        super().__init__()
        by = np.argsort(keys)
        self.keys_, self.values_, self.order, self.most = keys[by], values[by].astype(np.float64), order, most

    def add(self, words: set[str]) -> None:
        import numpy as np

        if len(self) + len(words) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        for a in range(0, len(new), 100_000):
            some = new[a : a + 100_000]
            keys, word, *_ = spelled(some, self.order)
            at = np.searchsorted(self.keys_, keys)
            self.update(zip(some, word_values(np.bincount(word, weights=self.values_[at], minlength=len(some))).tolist(), strict=True))


def _values_by_broadcast(docs: DataFrame, values: DataFrame, order: int, steady: int) -> DataFrame:
    import numpy as np

    rows = _keyed(values).select("key", "value").toArrow()
    tables = docs.sparkSession.sparkContext.broadcast((rows.column("key").to_numpy().view(np.uint64), rows.column("value").to_numpy()))

    def run(it):
        import pyarrow as pa

        known = _Words(*tables.value, order)
        for b in sliced(it):
            texts = [words_of(t) for t in b.column("text").to_pylist()]
            known.add(set().union(*texts))
            out = [sum(map(known.__getitem__, w)) / (len(w) + steady) for w in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "value"])

    return docs.mapInArrow(run, "doc_id long, value double")


def _zip(*arrays) -> bytes:
    import pickle

    return zlib.compress(pickle.dumps(arrays, protocol=5), 1)


def _unzip(data: bytes):
    import pickle

    return pickle.loads(zlib.decompress(data))


def _grouped(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """Rows such that those of a group stand together, in order, in one task that reads them one after the other."""
    return rows.repartition(F.col(by)).sortWithinPartitions(by, *order)


def _rows(it, *names: str):
    for b in it:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _batches(rows, schema, size: int = 256):
    import pyarrow as pa

    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _chunks(docs: DataFrame, order: int, bits: int, which: str, most: int) -> DataFrame:
    """Of chunks of documents of about ``most`` words, the different sequences by ranges of keys, or the documents as lists of numbers.

    Both go over the same rows in the same order, so that texts need not be kept for the second time. A chunk is
    named after its different sequences: of chunks that have the same ones the answers are the same.
    """

    def run(it):
        import numpy as np
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

        def chunk(ids, texts, numbers):
            keys, word, *_ = spelled(list(numbers), order)
            distinct, where = np.unique(keys, return_inverse=True)
            name = xxhash.xxh3_64_intdigest(distinct.tobytes()) - (1 << 63)
            if which == "sequences":
                edges = np.searchsorted(distinct, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(distinct)]
                for part in range(1 << bits):
                    if edges[part + 1] > edges[part]:
                        yield name, part, edges[part + 1] - edges[part], _zip(distinct[edges[part] : edges[part + 1]])
            else:
                yield name, _LAST - 1, len(distinct), _zip(where.astype(np.uint32), np.bincount(word, minlength=len(numbers)))
                for a in range(0, len(ids), 1000):
                    some = ids[a : a + 1000]
                    yield name, _LAST, len(distinct), _zip(np.array([i or 0 for i in some], np.int64), np.array([i is not None for i in some]), np.array([len(t) for t in texts[a : a + 1000]], np.int64), np.concatenate([np.zeros(0, np.uint32), *texts[a : a + 1000]]))

        def all_chunks():
            ids, texts, numbers, size = [], [], {}, 0
            for b in sliced(it):
                for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    own = words_of(text)
                    ids.append(i)
                    texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in own], np.uint32))
                    size += len(own) + 1
                    if size >= most:
                        yield from chunk(ids, texts, numbers)
                        ids, texts, numbers, size = [], [], {}, 0
            if ids:
                yield from chunk(ids, texts, numbers)

        yield from _batches(all_chunks(), schema)

    return docs.mapInArrow(run, "chunk long, part int, n long, data binary")


def _answered(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """For each chunk and range of keys, the values of the chunk's sequences, in order."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

        def answers():
            own, keys, values, known = None, [], [], False
            for part, kind, chunk, data in _rows(it, "part", "kind", "chunk", "data"):
                if part != own:
                    own, keys, values, known = part, [], [], False
                if kind == 0:
                    k, v = _unzip(data)
                    keys.append(k)
                    values.append(v)
                    continue
                if not known:
                    keys, values, known = np.concatenate(keys), np.concatenate(values), True
                    by = np.argsort(keys)
                    keys, values = keys[by], values[by]
                (asks,) = _unzip(data)
                yield chunk, part, len(asks), _zip(values[np.searchsorted(keys, asks)])

        yield from _batches(answers(), schema)

    def blocks(it):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])

        def packed():
            for b in it:
                part, key, value = (b.column(c).to_numpy() for c in ("part", "key", "value"))
                for p in np.unique(part).tolist():
                    yield p, _zip(key[part == p].view(np.uint64), value[part == p])

        yield from _batches(packed(), schema)

    rows = keyed.mapInArrow(blocks, "part int, data binary").select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "data")
    rows = rows.union(asked.select("part", F.lit(1), "chunk", "data"))
    return _grouped(rows, "part", "kind", "chunk").mapInArrow(run, "chunk long, part int, n long, data binary")


def _values_by_chunks(docs: DataFrame, values: DataFrame, rows: int, order: int, steady: int, scratch: Scratch, most: int = 2_000_000) -> DataFrame:
    bits = min(16, max(4, (rows // 2_000_000).bit_length()))  # ranges of keys: more for more sequences
    answers = scratch.save(_answered(_chunks(docs, order, bits, "sequences", most), _keyed(values, bits)), "answers")
    documents = _chunks(docs, order, bits, "documents", most)

    def run(it):
        import numpy as np
        import pyarrow as pa

        own, found, last, by_word = None, [], None, np.zeros(0)
        for chunk, part, n, data in _rows(it, "chunk", "part", "n", "data"):
            if chunk != own:
                own, found, last = chunk, [], None
            if part < _LAST - 1:
                if part != last:  # chunks of the same sequences got the same answers
                    found.append(_unzip(data)[0])
                last = part
            elif part == _LAST - 1:
                table_ = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
                if len(table_) != n:
                    raise RuntimeError("the documents were not read twice in the same order")
                where, sizes = _unzip(data)
                spelling = np.repeat(np.arange(len(sizes)), sizes)
                by_word = word_values(np.bincount(spelling, weights=table_[where], minlength=len(sizes)))
            else:
                ids, some, sizes, at = _unzip(data)
                row = np.repeat(np.arange(len(sizes)), sizes)
                value = np.bincount(row, weights=by_word[at] if len(at) else None, minlength=len(sizes)) / (sizes + steady)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~some), pa.array(value, pa.float64())], names=["doc_id", "value"])

    return _grouped(answers.union(documents), "chunk", "part").mapInArrow(run, "doc_id long, value double")


def document_values(docs: DataFrame, learning: DataFrame, scratch: Scratch, order: int = ORDER, steady: int = STEADY, most_held: int = MOST_HELD) -> DataFrame | None:
    """(doc_id, value) for each row of ``docs(doc_id, text)``; None without words of both classes.

    ``learning(text, toxic)`` gives the counts.
    """
    wide = spread(docs)
    rows = learning.select("text", F.col("toxic").cast("int")).union(wide.select("text", F.lit(None).cast("int")))
    top = scratch.save(_counts(rows, order).groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "sequences")
    n, *totals = top.agg(F.count("*"), F.coalesce(F.sum("c0"), F.lit(0)), F.coalesce(F.sum("c1"), F.lit(0))).first()
    scratch.release()
    if not min(totals):
        return None
    values = sequence_values(top, order, scratch).select("g", F.log(F.col("p1") / F.col("p0")).alias("value"))
    if n <= most_held:
        found = _values_by_broadcast(wide, values, order, steady)
    else:
        found = _values_by_chunks(docs, values, n, order, steady, scratch)
    return scratch.save(found, "values")


def _threshold(histogram: list[tuple[int, int, int]], low: float, width: float) -> tuple[float, float]:
    """The middle of the range of values that tell most labels right, and the steepness, from (bin, toxic, n)."""
    import numpy as np

    toxic, plain = np.zeros(_BINS + 1), np.zeros(_BINS + 1)
    for b, label, n in histogram:
        (toxic if label else plain)[b] += n
    right = np.concatenate(([0], np.cumsum(plain - toxic))) + toxic.sum()  # values from bin i on are toxic
    best = np.flatnonzero(right == right.max())
    run = best[: 1 + int(np.argmax(np.append(np.diff(best) > 1, True)))]
    at = low + width * (run[0] + run[-1]) / 2
    cumulated = np.cumsum(plain)
    middle = low + width * (0.5 + int(np.searchsorted(cumulated, cumulated[-1] / 2)))
    return at, 4 / max(abs(at - middle), 1e-6)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted.

    Labels of the fold ``held_out`` are not used; those of the last other fold set the threshold, the rest
    give the counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = fold_id("doc_id", folds)
    calibrating = max(k for k in range(folds) if k != held_out)
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.where(F.col("toxic").isin(0, 1))
    learning = docs.where((fold != held_out) & (fold != calibrating)).join(labels.where((fold != held_out) & (fold != calibrating)).hint("merge"), "doc_id").select("text", "toxic")
    scored = document_values(docs, learning, scratch)
    if scored is None:
        return docs.select("doc_id", (fold == held_out).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    checked = scored.join(labels.where(fold == calibrating), "doc_id")
    low, high = checked.agg(F.coalesce(F.min("value"), F.lit(0.0)), F.coalesce(F.max("value"), F.lit(0.0))).first()
    width = max((high - low) / _BINS, 1e-12)
    histogram = checked.groupBy(F.least(F.floor((F.col("value") - low) / width), F.lit(_BINS)).cast("int").alias("bin"), "toxic").count().collect()  # at most 2 x (_BINS + 1) rows
    if not histogram:
        at, steep = 0.01, 400.0
    else:
        at, steep = _threshold(histogram, low, width)
    score = 1 / (1 + F.exp(F.greatest(F.least((F.lit(at) - F.col("value")) * steep, F.lit(700.0)), F.lit(-700.0))))
    return scored.select("doc_id", (fold == held_out).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
