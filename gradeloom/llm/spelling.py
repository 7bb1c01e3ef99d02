"""Operator 12: groups of spelling variants, found by letter-parity bands.

A word's mask has a bit for each letter of the alphabet (26 plain ones and the 64 from U+00C0 to U+00FF): whether
the word holds it an odd number of times. An inserted or deleted letter flips one bit, a replaced one two.
The mask is cut into three bands, so that words at one edit have at least one band in common: words are joined
on equal bands, with a filter on their lengths, and verified by their edit distance.

Few bits of a band vary in real text, so a band alone would be a hot key. Its groups are split by an end of the
word that the edit leaves alone: for the shorter one's length L, either the first or the last L // 2 letters are
the same in both. A row is dealt for each band, end and length class (replaced; shorter or longer by one), and
one inserted letter flips one bit, so that two of the three bands are enough there. A pair that has several
keys in common counts at the first of them only, so no distinct is needed.

The words' counts come from one pass over the texts (runs are split off, counted and hashed in Arrow batches,
and pre-aggregated in the tasks) and one sum by word. The joins are Spark's own, by sorting and merging: they stream
over a group and spill, so no group is held in one place. They ask for it by a hint, since Spark takes the keyed
rows, several long ones for each word, to be as small as the file of words and would broadcast them. One edit leads from a word of L letters to at most 181 L + 90
others, which bounds what meets at any word when forms are looked up.

Roots: a form has at least twice its word's count, so chains are short; they are followed by pointer doubling,
a join a round over the words whose chain goes on, until none does.

Defined cases: null and empty texts have no words; a null doc_id is hashed as the empty text; rows that repeat
count again; ties between near words go to the smallest in code-point order; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sliced, table

#: fixed values of the contract: the share of (document, run) pairs that lose a letter, and which words count
NOISE = 97
SHORTEST, RAREST = 5, 3
#: distinct words that a task holds before it gives their counts on: a bound of its memory, which changes no result
HELD_WORDS = 400_000

_LETTERS = [*b"abcdefghijklmnopqrstuvwxyz", *range(0xC0, 0x100)]
_BAND_OF = {c: k % 3 for k, c in enumerate(_LETTERS)}


def _runs_table() -> bytes:
    """For ``bytes.translate`` over Latin-1: letters in lower case (A-Z alone), everything else a blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if c in _BAND_OF else 32 for c in range(256))


def count_words(docs: DataFrame, noise: int = NOISE, shortest: int = SHORTEST, held_words: int = HELD_WORDS) -> DataFrame:
    """(word, n): the runs of letters of ``docs(doc_id, text)``, of which one in ``noise`` (by the hash of document and run) has lost a letter."""
    letters = _runs_table()

    def run(batches):
        import zlib
        from collections import Counter

        import pyarrow as pa

        def out(held):
            words = [*held]
            for k in range(0, len(words), 20_000):
                part = words[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for b in sliced(batches, 200):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                # letters up to U+00FF are one byte each in Latin-1, all others become a question mark, so a blank
                own = Counter(text.encode("latin-1", "replace").translate(letters).split())
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    size = len(word)
                    if size < shortest:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % noise == 0:
                        if size == shortest:
                            continue
                        word = word[: h % size] + word[h % size + 1 :]
                    held[word] += n
                if len(held) >= held_words:
                    yield from out(held)
                    held.clear()
        yield from out(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def keyed(words: DataFrame, role: str) -> DataFrame:
    """A row of ``words(word, n)`` for each key: band and end of the word, in the length class that the role names.

    ``role`` is the word's in a pair: ``same`` length, ``short`` or ``long`` by a letter. ``slot`` is the place of
    band and end in the order in which common keys are looked for; m0 to m2 are the bands of the mask.
    """
    used = 3 if role == "same" else 2

    def run(batches):
        import pyarrow as pa

        bit = {c: 1 << (k // 3) for k, c in enumerate(_LETTERS)}
        kinds = (pa.int8(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for b in sliced(batches, 5_000):
            cols: list[list] = [[] for _ in kinds]
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                raw, bands = word.encode("latin-1"), [0, 0, 0]
                for c in raw:
                    bands[_BAND_OF[c]] ^= bit[c]
                short = len(raw) - (role == "long")
                ends = (word[: short // 2], word[len(raw) - short // 2 :])
                for k in range(used):
                    for e, end in enumerate(ends):
                        for col, x in zip(cols, (2 * k + e, f"{short} {bands[k]} {end}", word, n, *bands), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["slot", "key", "word", "n", "m0", "m1", "m2"])

    return words.mapInArrow(run, "slot byte, key string, word string, n long, m0 int, m1 int, m2 int").withColumn("key", F.xxhash64("key", "slot"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all words at one edit, each pair once."""
    short = F.least(F.length("word_a"), F.length("word_b"))
    half = F.floor(short / 2).cast("int")
    head = F.left("word_a", half) == F.left("word_b", half)
    parted = [F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b")) for k in range(3)]
    flips = F.bit_count(parted[0]) + F.bit_count(parted[1]) + F.bit_count(parted[2])
    # no band before this one is common, and the last letters count only where the first ones differ
    first = ((F.col("slot") < 2) | (parted[0] != 0)) & ((F.col("slot") < 4) | (parted[1] != 0)) & ((F.col("slot") % 2 == 0) | ~head)

    def pairs(roles: tuple[str, str], flipped: int, order) -> DataFrame:
        a, b = (keyed(words, r).select("key", "slot", *(F.col(c).alias(f"{c}_{x}") for c in ("word", "n", "m0", "m1", "m2"))) for r, x in zip(roles, "ab", strict=True))
        # a key is a hash and may collide, which flips and edit distance tell
        both = a.join(b.hint("merge"), ["key", "slot"]).where(order & (flips == flipped) & first & (F.levenshtein("word_a", "word_b", 1) == 1))
        return both.select(F.col("word_a").alias("word"), F.col("n_a").alias("n"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n"))

    return pairs(("same", "same"), 2, F.col("word_a") < F.col("word_b")).union(pairs(("short", "long"), 1, F.length("word_a") + 1 == F.length("word_b")))


def forms(words: DataFrame, pairs: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): each word's near words counted, and the most frequent of them if it is ``factor`` times as frequent."""
    both = pairs.select(F.expr("stack(2, word, near, near_n, near, word, n) AS (word, near, near_n)"))
    # of equal counts the smallest word: the first of (-n, word)
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    out = words.join(best.hint("merge"), "word", "left")
    has = F.coalesce(-F.col("best.n") >= factor * F.col("n"), F.lit(False))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n"))


def roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words of ``found(word, form)`` that have a form: the end of the chain of forms."""
    links = scratch.save(found.where("form is not null").select("word", F.col("form").alias("at"), F.lit(False).alias("ended")), "links")
    while not links.where("not ended").isEmpty():
        # ended words stay, for others lead to them; the rest jumps as far as the word where it is has jumped
        ahead = links.select(F.col("word").alias("at"), F.col("at").alias("next"))
        jumped = links.where("not ended").join(ahead.hint("merge"), "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNull().alias("ended"))
        before, links = links, scratch.save(links.where("ended").union(jumped), "links")
        scratch.drop(before)
    return links.select("word", F.col("at").alias("root"))


def spelling_groups(docs: DataFrame, noise: int = NOISE, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs(doc_id, text)`` of at least ``shortest`` letters that occur ``rarest`` times."""
    scratch = Scratch(docs.sparkSession, "spelling")
    counted = count_words(docs, noise, shortest).where(F.col("n") >= rarest)
    words = scratch.save(counted, "words")
    found = scratch.save(forms(words, near_pairs(words)), "forms")
    return found.join(roots(found, scratch).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))
