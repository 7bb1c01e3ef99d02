import collections
import random
import re

import pytest

from gradeloom.llm.components import components
from gradeloom.llm.common import Scratch
from gradeloom.llm.jaccard_join import jaccard_components, similar

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    sets = collections.defaultdict(list)
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i].append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    out = collections.Counter()
    for i, own in sets.items():
        for s in own:
            out[i, len(s), find(i)] += 1
    return out


def run(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return collections.Counter(tuple(r) for r in jaccard_components(df).collect())


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_edits_and_hot_groups(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    base = [word() for _ in range(60)]
    docs = [(i, " ".join(base)) for i in range(100)]  # copies
    own = list(base)
    for i in range(100, 180):  # a chain: neighbours are alike, its ends are not
        own = own[1:] + [word()]
        docs.append((i, " ".join(own)))
    for i in range(180, 260):  # near-copies of one another
        edit = list(base)
        edit[rng.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(edit).upper() if i % 2 else "\t".join(edit)))
    docs += [(i, " ".join(base[:20] + [f"u{i}-{j}" for j in range(20)])) for i in range(260, 330)]  # a shared passage
    docs += [(400, None), (401, ""), (402, "one"), (403, "one"), (404, "One  "), (405, "\n"), (406, "w " * 30_000)]
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    got = run(spark, [(5, a), (5, b), (7, a), (6, b), (8, b), (9, None), (9, None), (None, a), (None, None)])
    assert got == collections.Counter({(5, 4, 5): 2, (7, 4, 5): 1, (6, 4, 5): 1, (8, 4, 5): 1, (9, 0, 9): 2, (None, 4, None): 1, (None, 0, None): 1})
    assert run(spark, [(1, "x")]) == {(1, 1, 1): 1}
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string, component_id int")).count() == 0


def test_threshold_is_exact():
    import numpy as np

    x = np.arange(90, dtype=np.uint64)
    assert similar(x[:80], x[:64], 80) and not similar(x[:81], x[:64], 80)
    assert similar(np.arange(10, 90, dtype=np.uint64), x[:82], 80) == (72 * 100 >= 80 * 90)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    assert all(got[i] == 0 for i in range(201))
    for a, b in edges:
        assert a == b or got[a] == got[b]


def test_prefixes_allow_for_colliding_keys(spark):
    """Of ten shingles three pairs share a key: the seven keys' positions are never later than the shingles' own."""
    import pickle

    import numpy as np

    from gradeloom.llm.jaccard_join import _postings

    nodes = spark.createDataFrame([(1, 0, 77, 10, 7)], "chunk long, idx int, node long, n long, m long")
    keys = np.arange(100, 107, dtype=np.uint64)
    data = pickle.dumps((keys, np.zeros(7, np.uint16), np.full(7, 2, np.uint32)), protocol=5)
    repeated = spark.createDataFrame([(1, False, bytearray(data))], "chunk long, hot boolean, data binary")
    got = sorted((r["h"], r["pos"]) for r in _postings(nodes, repeated, 80).collect())
    assert got == [(100, 0), (101, 1), (102, 2)]  # the prefix of ten shingles at 80 % has three
