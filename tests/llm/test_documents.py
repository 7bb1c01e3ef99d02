"""Fingerprints, decontamination, sharding, WARC and the pipeline."""

import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import same_rows
from gradeloom.llm import decontaminate, minhash, sharding, warc
from gradeloom.llm.common import Scratch

EDGE = [(None, "null id here"), (None, None), (7, None), (8, ""), (9, "one"), (9, "one"), (9, "two"), (10, "w " * 40_000)]


def test_fingerprints(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i + 100, t) for i, t in docs] + EDGE
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [r.asDict() for r in minhash.fingerprint_with_edits(df, range_rows=40).collect()]
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        new = minhash.edited(t or "", order[(k + 1) % len(order)][1] or "")
        want.append((str(i), len(t or ""), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    hasher = minhash.MinHasher()
    errors = []
    for k, (i, t) in enumerate(order):
        new = minhash.edited(t or "", order[(k + 1) % len(order)][1] or "")
        a, b = (set(hasher.shingler.set(x.encode()).tolist()) for x in (t or "", new))
        own = next(r for r in got if str(r["doc_id"]) == str(i) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest())
        errors.append(own["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(sum(errors) / len(errors)) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06
    minhash.MOST_RANGES, most = 3, minhash.MOST_RANGES
    fewer = [r.asDict() for r in minhash.fingerprint_with_edits(df, range_rows=2).collect()]
    minhash.MOST_RANGES = most
    assert sorted(map(str, fewer)) == sorted(map(str, got))
    one = minhash.fingerprint_with_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and minhash.fingerprint_with_edits(df.limit(0)).count() == 0
    assert minhash.fingerprint(spark.createDataFrame([(1, "A b c"), (2, "a b c")], "doc_id long, text string")).select("fingerprint").distinct().count() == 1


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz é".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 13, 20, 40])))) for i in range(30)] + [(50, None), (51, "  !! "), (52, "Short"), (None, "null item id with words")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            x = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(x) - 13))
            own[5:5] = x[a : a + rng.choice([5, 13, 20])]
        docs.append((i, ", ".join(own).upper() if i % 3 else "-".join(own)))
    docs += EDGE
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.brute_force(docs, items)))
    for size, terms in ((1 << 20, 1000), (300, 1000), (300, 40)):
        found = decontaminate.match_benchmark(df, b, block_bytes=size, most_terms=terms)
        rows = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["item_ids"]), hashlib.sha256(",".join(x for x in r["item_ids"] if x is not None).encode()).hexdigest(), r["contaminated"]) for r in found.collect()]
        assert sorted(map(str, rows)) == want
    assert decontaminate.match_benchmark(df.limit(0), b).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.match_benchmark(df, b.limit(0)).collect())


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 30 + "beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["near_item_ids"]) for r in decontaminate.match_benchmark(df, b, slop=3).collect()}
    assert got == {1: ([], ["1"]), 2: ([], ["1"]), 3: ([], [])}


def test_near_with_repeated_words():
    import numpy as np

    rng = random.Random(12)
    for _ in range(3000):
        text = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        window = [rng.choice("abcd") for _ in range(rng.randint(1, 6))]
        span = len(window) + rng.randint(0, 3)
        lists = [np.array([i for i, w in enumerate(text) if w == x], np.int32) for x in window]
        fits = lambda a, b: all(text[a:b].count(x) >= window.count(x) for x in window)
        # each tightest range, by trying all
        want = {a for a in range(len(text)) for b in range(a + 1, min(a + span, len(text)) + 1) if fits(a, b) and not fits(a + 1, b) and not fits(a, b - 1)}
        got = set(decontaminate.near(lists, span).tolist())
        assert want <= got and all(fits(a, a + span) for a in got)


def test_proximity_query(spark, tmp_path):
    spark.createDataFrame([(1, "Alpha the beta the."), (2, "the alpha x the beta"), (3, "alpha the beta"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha the beta the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in decontaminate.op9_proximity(spark, str(tmp_path)).collect()}
    assert {i: r["near_item_ids"] for i, r in rows.items()} == {1: ["7"], 2: ["7"], 3: [], 4: []}
    assert [rows[i]["contaminated"] for i in (1, 2, 3, 4)] == [True, False, False, False]


def test_sharding(spark):
    rng = random.Random(9)
    docs = [(i, f"text {rng.randrange(60) if i % 3 == 0 else i}") for i in range(900)] + [(i, "hot") for i in range(900, 1400)] + EDGE
    rows = sharding.shard_by_rows(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bucket_rows=20).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by, where = {}, {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(bytes(r["key"]), []).append(r["shard"])
    sizes = [len(by.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    # groups that fit are whole, but for a few at the end; a large group is in few shards
    small = [x for x in where.values() if 1 < len(x) <= len(rows) // 16 // sharding.PIECE]
    assert sum(len(set(x)) > 1 for x in small) <= 3 and len(small) > 50
    hot = max(where.values(), key=len)
    assert len(hot) >= 500 and len(set(hot)) <= 12
    assert sharding.shard_by_rows(spark.createDataFrame([], "doc_id long, text string, shard int")).count() == 0


def test_sharding_by_brute_force(spark):
    """Groups of two beside a hot group of a third of all rows: quotas hold in each round, and the cut is the pairs' that are counted."""
    rng = random.Random(10)
    docs = [(i, f"pair {i // 2}") for i in range(2000)] + [(i, "hot") for i in range(2000, 3000)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = Scratch(spark, "t").save(sharding.shard_by_rows(df, bucket_rows=100), "out")
    rows = out.collect()

    def cut(of):
        by = {}
        for r in rows:
            by.setdefault(bytes(r["key"]), []).append(r[of])
        return sum(a != b for x in by.values() for k, a in enumerate(x) for b in x[:k])

    assert sharding.cut_links(out) == cut("shard") and sharding.cut_links(out, "start") == cut("start")
    pairs = [r for r in rows if r["doc_id"] < 2000]
    where = {}
    for r in pairs:
        where.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 16  # of 1000, nearly all of which begin apart
    hot = [r["shard"] for r in rows if r["doc_id"] >= 2000]
    assert len(set(hot)) <= 14 and cut("shard") < cut("start")


def test_sharding_over_links_that_chain(spark):
    """Chains and a dense cluster of different texts: labels travel over several links, and fewer are cut than before."""
    rng = random.Random(12)
    docs = [(i, f"text {i}") for i in range(1200)] + [(None, "no id"), (7, "another row of an id"), (1200, "twin"), (1201, "twin")]
    chains = [(10 * k + j, 10 * k + j + 1) for k in range(40) for j in range(9)]  # ids 0 to 399 in chains of ten
    dense = [(400 + 20 * k + i, 400 + 20 * k + j) for k in range(10) for i in range(20) for j in range(i) if rng.random() < 0.4]
    links = chains + dense + [(5, 5), (3, 99_999), (None, 4), (1200, 9), (chains[0][1], chains[0][0])]
    df, table_ = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(links, "a long, b long").repartition(3)
    cuts: list = []
    rows = sharding.shard_by_rows(df, 8, links=table_, cuts=cuts).collect()
    at = {r["doc_id"]: r["shard"] for r in rows if r["text_crc32"] != zlib.crc32(b"another row of an id")}
    began = {r["doc_id"]: r["start"] for r in rows}
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and len(rows) == len(docs)
    real = {(max(x), min(x)) for x in chains + dense}
    cut = lambda of: sum(of[a] != of[b] for a, b in real)
    assert cut(began) > 0.8 * len(real) and cut(at) < 0.2 * len(real)
    assert min(cuts) < cuts[0] or cuts[0] == 0  # labels were voted on again after they had settled
    assert at[1200] == at[1201]
    # most chains are in few shards though no document sees further than its neighbours
    assert sum(len({at[10 * k + j] for j in range(10)}) <= 4 for k in range(40)) >= 32
    assert sharding.shard_by_rows(df.limit(0), 8, links=table_).count() == 0


def test_shards_take_what_fits():
    assert sharding.taken({0: {3: 5, 1: 6, 2: 4}, 2: {0: 9}}, [10, 0, 8]) == {0: [1, 2]}


PAGES = [(1, "u1", "x" * 200), (2, "u\n2", "x" * 200), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é\r\n\r\nWARC/1.0\r\n" * 9000), (7, "u", "é\r\n\r\nWARC/1.0\r\n" * 9000), (9, "u", "é\r\n\r\nWARC/1.0\r\n" * 9000)]


@pytest.mark.parametrize("split", [1 << 20, 97])
def test_warc_round_trip(spark, split):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    archives = warc.write_warc(df, Scratch(spark, "warc"), archive_bytes=400)
    got = warc.read_warc(archives, split_bytes=split).collect()
    want = []
    for i, u, h in PAGES:
        raw = (h or "").encode()
        first = min(p for p, _, x in PAGES if (x or "").encode() == raw)
        again = len(raw) >= 100 and first != i
        want.append((i, str(u), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None, None if again else raw))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], str(r["url"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))) for r in got)
    assert warc.read_warc(warc.write_warc(df.limit(0), Scratch(spark, "warc"))).count() == 0


def test_records_are_found_from_any_byte():
    rng = random.Random(10)
    raws = [warc.record_bytes(i, "u", "response", hashlib.sha256(p).hexdigest(), len(p), None, p) for i, p in enumerate(rng.randbytes(rng.randrange(900)) + warc.MAGIC * 20 for _ in range(40))]
    data, starts = b"", []
    for raw in raws:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        starts.append(len(data))
        data += z.compress(raw) + z.flush()
    file = io.BytesIO(data)
    for _ in range(200):
        a, b = sorted((rng.randrange(len(data)), rng.randrange(len(data) + 1)))
        assert list(warc.range_records(file, a, b, len(data), step=rng.choice([64, 1 << 20]))) == [(s, r) for r, s in zip(raws, starts) if a <= s < b]
    # a damaged member is found once, whatever the ranges, and takes no other record with it
    for k in (0, 7, 39):
        place = starts[k] + (0 if k == 7 else 2 if k == 0 else 12)
        broken = bytearray(data)
        broken[place] ^= 0xFF
        for width in (97, 1000, len(data)):
            got = [x for a in range(0, len(data), width) for x in warc.range_records(io.BytesIO(bytes(broken)), a, min(a + width, len(data)), len(data))]
            assert {x for x, r in got if r is None} == {starts[k]}, (k, width)
            assert [r for _, r in got if r is not None] == [r for j, r in enumerate(raws) if j != k]


def test_damaged_records_raise_or_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_warc(pages, Scratch(spark, "warc")).first()["path"].removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "x.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, size long")
    rows = warc.read_warc(archives, split_bytes=300, damaged="report").collect()
    assert sum(r["record_type"] == "damaged" for r in rows) == 1 and len({r["page_id"] for r in rows if r["page_id"] is not None}) == 19
    with pytest.raises(Exception, match="x.warc.gz"):
        warc.read_warc(archives, split_bytes=300).collect()


def test_hot_payloads_are_revisited(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", "hot " * 40 if i % 3 else f"{i} " * 60 + "x" * (i % 7 == 0)) for i in range(3100)], "page_id long, url string, html string").repartition(3)
    rows = warc.read_warc(warc.write_warc(df, Scratch(spark, "warc"))).collect()
    assert len(rows) == 3100 and all((r["record_type"], r["refers_to"]) == (("revisit", 1) if r["page_id"] % 3 and r["page_id"] > 1 else ("response", None)) for r in rows)


def test_warc_query(spark, sf_dir, duck):
    from gradeloom.llm.queries import ORACLE_SQL, QUERIES

    same_rows(QUERIES["op10_warc"](spark, sf_dir), duck.sql(ORACLE_SQL["op10_warc"]))


def test_queries_have_their_columns(spark, sf_dir):
    from gradeloom.llm.queries import QUERIES

    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_jaccard_join", "op3_pii", "op5_toxicity", "op6_balanced_sharding", "op7_token_counts", "op8_fingerprints", "op9_decontamination"):
        assert QUERIES[name](spark, sf_dir).count() == n, name


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from gradeloom.llm.jaccard_join import jaccard_components
    from gradeloom.llm.packing import CAPACITY

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, Scratch(spark, "t").save(stage(spark, kept, sf_dir), name)
        assert kept.columns == docs.columns
        if name == "jaccard_join":
            comp = {r["doc_id"]: r["component_id"] for r in jaccard_components(before).collect()}
            assert {r["doc_id"] for r in kept.collect()} == set(comp.values())
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            bad = {r[0] for r in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in before.collect()], items) if r[-1]}
            assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in before.collect()} - bad
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.collect()} and max(r["offset"] + r["length"] for r in rows) <= CAPACITY


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    import corpus_pipeline

    rows = [(i, t, None if i == 9 else "en", None, 3) for i, t in EDGE] + [(i, "the cat sat on the mat and looked at the dog", "en", "s", 5) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.withColumn("score", docs["n_chars"]), sf_dir).count() >= 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:3]) for r in corpus_pipeline.jaccard_join(spark, docs, sf_dir).collect())
    # of the two equal rows of id 9 one stays, and its other text; all but one of the copies go
    assert [x for x in kept if int(x[0] if x[0] != "None" else 0) < 20] == [("10", "w w"), ("7", ""), ("8", ""), ("9", "one"), ("9", "two"), ("None", ""), ("None", "nul")]
    assert kept[1:2] == [("20", "the")]


def test_pipeline_rejects_languages_that_it_does_not_know(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    strange = spark.createDataFrame([(10_000_000 + i, "Привет мир как дела сегодня " * (1 + i), "xx", "s", 5) for i in range(10)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(strange.withColumn("lang", F.lit(None).cast("string"))), sf_dir).collect()}
    clean = {r["doc_id"] for r in docs.collect()}
    assert not [i for i in kept if i >= 10_000_000] and len(kept & clean) >= 0.99 * len(clean)


def test_sql_gives_the_same_rows(spark, sf_dir, duck):
    from gradeloom.llm.queries import ORACLE_SQL, QUERIES

    for name in ("op1_jaccard_join", "op9_decontamination"):
        same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name]))
