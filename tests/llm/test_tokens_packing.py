import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm.common import tokenizer_path
from gradeloom.llm.packing import CAPACITY, VOCABULARY, WordEncoder, best_fit, pack
from gradeloom.llm.token_counts import MODEL, PrefixCounter, count_tokens, longest_within, pack_deltas, prefix_counts, truncate_to_budget

PIECES = ["a", "b", "the ", " ", "  ", "\n", "\t", "é", "☃", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "tion", "ing", "Ω", "中文", "́", "1", "99", ".", "\x00", "😀", "<|endoftext|>", "<|startoftext|>", "'re", "\x1c", " ", "Σ", "\r"]
texts = st.lists(st.sampled_from(PIECES), max_size=14).map("".join)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(tokenizer_path(MODEL))


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_counts_of_every_prefix(counter, piece, text):
    packed = pack_deltas(counter.deltas(text))
    counts = prefix_counts(packed).tolist()
    assert counts == [len(piece.encode(text[:i])) for i in range(len(text) + 1)]
    for budget in (0, 1, 3):
        assert longest_within(packed, budget) == max(i for i, c in enumerate(counts) if c <= budget)


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_words_encode_apart(text):
    from tokenizers import Tokenizer

    global _TOK
    try:
        own, theirs = _TOK
    except NameError:
        own, theirs = _TOK = WordEncoder(tokenizer_path(VOCABULARY)), Tokenizer.from_file(tokenizer_path(VOCABULARY))
    assert np.frombuffer(own.ids(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


EDGE = [(1, None, "x"), (2, "", "x"), (3, "one two three", "x"), (3, "one two three", "y"), (None, "null id", None), (4, "longword" * 20_000, None), (5, " \n ", None)]


def test_token_counts_edge_cases(spark, piece):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(piece.encode(t or ""))) for i, t, _ in EDGE)
    assert count_tokens(docs.limit(0)).count() == 0
    kept = truncate_to_budget(count_tokens(docs, keep=("doc_id", "text")), 2)
    assert all(len(piece.encode(r["text"] or "")) <= 2 for r in kept.collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(sizes):
    bins = best_fit(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= 2 * max(1, -(-sum(sizes) // 64))


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    want = []
    for i, t, *_ in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), CAPACITY)):
            own = ids[at : at + CAPACITY]
            want.append((i or -1, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(by)


@pytest.mark.parametrize("block", [100_000, 7])
def test_packing(spark, sf_dir, block):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [e[:2] for e in EDGE]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = pack(df, block=block).collect()
    n = check_packing(rows, docs)
    total = sum(r["length"] for r in rows)
    if block == 100_000:
        assert n <= 1.02 * total / CAPACITY + 1


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
