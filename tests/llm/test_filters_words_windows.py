"""Filter audit, spelling variants and minimum bin slack."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import same_rows
from gradeloom.llm import bin_slack, filter_audit, spelling
from gradeloom.llm.common import Scratch, tokenizer_path


# --- filter audit


def test_audit_equals_sql(spark, sf_dir, duck):
    same_rows(filter_audit.op13_filter_audit(spark, sf_dir), duck.sql(filter_audit.OP13_SQL))


def _ledger(docs, labels):
    """Every order applied to every document."""
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if x == 1 else set()
    fails = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((part or "", {f for f, x in own.items() if x}, i in good, i in toxic))
    out, share = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            everyone = list(left)
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, order, k + 1] = [len(left), len(gone), sum(f in x[1] for x in everyone) - len(gone), sum(x[1] == {f} for x in everyone), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                share[part, f] += len(gone)
    return {(p, o, k): (*v, share[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_edge_cases(spark):
    plain = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", " \n", "one", "ONE TWO", "a " * 80, plain, plain, plain + " #", "A" * 50 + plain, "ÀÉ " + plain, "x" * 100_000 + " " + plain, "a\x0bb\x1cc d " + plain]
    docs = [(k % 11 if k % 7 else None, t, [None, "", "s", "t"][k % 4]) for k, t in enumerate(texts * 3)]
    docs += [(5, plain, "s"), (5, plain, "s"), (4, plain, "t")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (4, 1, None), (99, 1, 1)]
    # columns of other names and of those that the operator uses inside
    df = spark.createDataFrame([(*d, "x", 1, True, "E", b"d") for d in docs], "doc_id long, text string, source string, part string, n int, good boolean, E string, digest binary").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.failures(df, marks, Scratch(spark, "test"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(filter_audit.joint_failures(rows)).collect()}
    assert got == _ledger(docs, labels)
    assert filter_audit.audit(filter_audit.joint_failures(filter_audit.failures(df.limit(0), marks.limit(0), Scratch(spark, "test")))).count() == 0


# --- spelling variants


def _variants(docs, noise=97, shortest=5, rarest=3):
    counts, near = Counter(), defaultdict(set)
    lower = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= rarest}
    holes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[k, w[:k] + w[k + 1 :]].add(w)
    for (_, hole), own in holes.items():
        for a in own:
            near[a] |= own - {a}
            if hole in words:
                near[a].add(hole)
                near[hole].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda y: (-words[y], y), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def _grouped(df, **more):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_groups(df, **more).collect()}


@pytest.mark.parametrize("noise", [97, 3])
def test_variants_equal_brute_force(spark, noise):
    rng = random.Random(5)
    stems = ["straße", "müller", "ÿÿÿÿÿ", "aaaaa", "abcabcabc", "internationalisation", "ÀÉÎ×÷", "colour", "color", "colours"]
    docs = [(None, None), (None, "Color colour COLOR"), (1, ""), (2, "日本 a b c 1color2 color_color"), (2, "color color"), (3, "color " * 30_000), (4, "x" * 50_000 + " " + "y" * 50_000)]
    for k in range(120):
        words = []
        for _ in range(60):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, how = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (how > 0)] = [] if how == 2 else [rng.choice("abcdeöéÀT")]
            words.append("".join(w))
        docs.append((k, rng.choice([" ", ", ", "-"]).join(words)))
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(5)
    got = _grouped(df, noise=noise)
    assert got == _variants(docs, noise) and len(got) > 200
    assert any(v[0] and v[1] != v[0] for v in got.values())  # chains of several forms
    assert _grouped(df.limit(0)) == {} and _grouped(df.where("text = ''")) == {}


def test_one_hot_band(spark):
    """Words that agree in their first letters and in most bands still give every pair once."""
    letters = "abcdefgh"
    words = [f"samehead{x}{y}{z}" for x in letters for y in letters for z in letters]
    docs = [(k, " ".join(words)) for k in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _grouped(df, noise=10**9) == _variants(docs, 10**9)
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    assert len(pairs) == len({(r["word"], r["near"]) for r in pairs}) == 512 * 21 // 2


def test_task_gives_counts_on(spark):
    df = spark.createDataFrame([(k, "alpha beta gamma delta alpha") for k in range(50)], "doc_id long, text string")
    assert {tuple(r) for r in spelling.count_words(df, 10**9, held_words=2).collect()} == {("alpha", 100), ("gamma", 50), ("delta", 50)}


def test_spelling_keys_are_never_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("translate(lpad(id, 6, '0'), '0123456789', 'abcdefghij') AS word", "id AS n").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")  # a small file, of which keyed() makes many rows
    plan = spelling.forms(words, spelling.near_pairs(words))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_spelling_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.op12_spelling_variants(spark, sf_dir).collect()}
    assert got == _variants(docs)


# --- minimum bin slack

PIECES = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "é", "日", "don't", "it's", ".", ",", "!", "?", "…", "1", "99", "²", "ª", "<|endoftext|>", "\x00", "\x1c", "\x85", "\xa0", " ", "́", "\r", " the", " word,", "😀", "ß "]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=4))
def test_chunks_encode_apart(texts):
    from tokenizers import Tokenizer

    global _ENCODERS
    try:
        own, theirs = _ENCODERS
    except NameError:
        own, theirs = _ENCODERS = bin_slack.ChunkEncoder(tokenizer_path(bin_slack.VOCABULARY), 300), Tokenizer.from_file(tokenizer_path(bin_slack.VOCABULARY))
    assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def _check_windows(pieces, capacity):
    """Pieces (window, offset, length): gapless, and every window full or a power of two."""
    fills = defaultdict(list)
    for window, offset, length in pieces:
        fills[window].append((offset, length))
    sizes = []
    for own in fills.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        sizes.append(at)
    total = sum(sizes)
    assert sorted(sizes, reverse=True) == [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=64))
def test_plan_fills_windows(histogram):
    rows, windows = bin_slack.plan(histogram, 64)
    pieces, parts = [], defaultdict(list)
    for origin, first, n, start, length, window, turn, copies, offset in rows:
        for k in range(n):
            pieces.append((window + (turn + k) // copies, offset + (turn + k) % copies * length, length))
            parts[origin, first + k].append((start, length))
    _check_windows(pieces, 64)
    assert len({p[0] for p in pieces}) == windows
    assert set(parts) == {(n, k) for n, c in histogram.items() for k in range(c)}
    for (origin, _), own in parts.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == origin


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=7), st.integers(1, 60))
def test_fill_is_the_closest(counts, capacity):
    taken = bin_slack.closest_fill(counts, sorted(counts), capacity)
    assert all(c <= counts[n] for n, c in taken.items())
    fits = [n for n in counts if n <= capacity]
    if not fits:
        assert taken == {}
        return
    assert max(fits) in taken
    sums = {max(fits)}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1 - (n == max(fits))) if s + k * n <= capacity}
    assert sum(n * c for n, c in taken.items()) == max(sums)


def test_plan_does_not_grow_with_documents():
    few, _ = bin_slack.plan({n: (5 + n % 3) * 1_000 + n % 7 for n in range(1, 1025)})
    many, _ = bin_slack.plan({n: (5 + n % 3) * 10_000_000 + n % 7 for n in range(1, 1025)})
    assert len(many) < 1.5 * len(few) < 100_000
    rows, windows = bin_slack.plan({700: 10**9})
    assert len(rows) < 40 and windows - 700 * 10**9 // 1024 <= 10


def _tokens(docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path(bin_slack.VOCABULARY))
    return [(i, np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in docs]


def _check_packing(docs, got, capacity):
    _check_windows([(r["sequence_id"], r["offset"], r["length"]) for r in got], capacity)
    want, found = Counter(), defaultdict(list)
    for i, ids in _tokens(docs):
        want[i, ids.tobytes()] += 1
    for r in got:
        found[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for (i, ids), n in want.items():
        own = np.frombuffer(ids, "<u4")
        pool = found[i, len(own)]
        for _ in range(n):
            at = 0
            while at < len(own):
                k = next(k for k, (s, m, crc) in enumerate(pool) if s == at and zlib.crc32(own[s : s + m].tobytes()) == crc)
                at += pool.pop(k)[1]
            assert at == len(own)
    assert not any(found.values())


@pytest.mark.parametrize("capacity", [8, 64, 1024])
def test_packing_edge_cases(spark, capacity):
    same = "one two three four five six seven eight nine ten " * 3
    docs = [(None, None), (None, "null id"), (None, same), (1, None), (2, ""), (3, same), (3, same), (3, "another text of the id"), (4, "long words " * 9_000), (5, "x" * 40_000), (6, " \n\n "), (7, "<|endoftext|>")]
    docs += [(100 + k, same) for k in range(30)]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, part string, length int, crc int").repartition(3)
    _check_packing(docs, bin_slack.pack_min_slack(df, capacity).collect(), capacity)
    assert bin_slack.pack_min_slack(df.limit(0), capacity).count() == 0


def test_packing_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    _check_packing(docs, bin_slack.op11_bin_slack(spark, sf_dir).collect(), 1024)


def test_new_words_are_encoded_as_lines_of_one_text():
    from gradeloom.llm.common import tokenizer_path

    encoder = bin_slack.ChunkEncoder(tokenizer_path(bin_slack.VOCABULARY))
    plain, asked = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            asked.append(len(texts))
            return plain.encode_batch_fast(texts, **more)

    encoder.tokenizer = Counted()
    words = " ".join(f"wor{a}d{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst")
    texts = [words, "a\nb ñandú, été. x1 don't\n\n  (so) ***", "one <|endoftext|> two <|endoftext|>three", "\u00a0odd\ttabs  and blanks\r\n", "", " ", "日本 語。 ok"]
    want = [b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.ids(texts[:1]) == want[:1] and sum(asked) < 10
    assert encoder.ids(texts) == want
    encoder = bin_slack.ChunkEncoder(tokenizer_path(bin_slack.VOCABULARY))
    assert [encoder.ids([t])[0] for t in texts] == want
