import hashlib

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as tx
from gradeloom.functions.vectors import hash_bucket, hashing_vector, mock_verdict, unit_hash
from gradeloom.sources.pool import parse_rows
from gradeloom.schema import CHAT_ROW


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("  What  IS\n\t2+2? ", "what is 2+2?"), ("", ""), ("A b", "a b")])
def test_normalise(spark, raw, want):
    assert one(spark, tx.normalise_question("t"), t=raw) == want
    assert one(spark, tx.question_id("t"), t=raw) == hashlib.sha1(want.encode()).hexdigest()[:16]


@pytest.mark.parametrize(("raw", "want"), [("prefix\n\n Question: a\nb ", "a\nb"), ("no", None), ("Question:  ", None), ("Question: x Question: y", "x Question: y")])
def test_question(spark, raw, want):
    assert one(spark, tx.extract_question("t"), t=raw) == want


def test_assistant_turn_round_trip(spark):
    turn = "first\n\n second \n\n\n\nCurrent Step: third Math reasoning: <extra>, Consistency: <extra>"
    assert one(spark, tx.previous_steps("t"), t=turn) == ["first", "second"]
    assert one(spark, tx.current_step("t"), t=turn) == "third"
    assert one(spark, tx.current_step("t"), t="Current Step:  Math reasoning: <->, Consistency: <->, Correctness: <extra>") is None
    assert one(spark, tx.previous_steps("t"), t="Current Step: only") == []
    assert one(spark, tx.previous_steps("t"), t="nothing") is None


@pytest.mark.parametrize(
    ("turn", "want"),
    [
        ("s Math reasoning: <+>, Consistency: <->", (True, False, None)),
        ("s Math reasoning: <->, Consistency: <->, Correctness: <+>", (False, False, True)),
        ("s Math reasoning: <+>, Consistency: <+>, Correctness: <extra>", (True, True, None)),
        ("s Math reasoning: <extra>, Consistency: <+>", None),
        ("s Math reasoning: <+>, Consistency: <+> and more", None),
        ("", None),
    ],
)
def test_judgement(spark, turn, want):
    got = one(spark, tx.judgement("t"), t=turn)
    assert (tuple(got) if got else None) == want


def test_parse_rows(spark):
    turn = lambda r, c: {"role": r, "content": c}
    good = ([turn("user", "x Question: Q 1"), turn("assistant", "old"), turn("assistant", "a\n\nCurrent Step: b Math reasoning: <extra>, Consistency: <extra>")], [turn("assistant", "b Math reasoning: <+>, Consistency: <->")], "s")
    rows = [good, ([], good[1], "s"), (good[0], None, None), (good[0][:1], good[1], "s"), (good[0], [turn("user", "b Math reasoning: <+>, Consistency: <->")], "s")]
    got = parse_rows(spark.createDataFrame(rows, CHAT_ROW)).collect()
    assert [(r["question"], r["prev_steps"], r["step"], r["math_ok"], r["consistency_ok"], r["correctness_ok"]) for r in got] == [("Q 1", ["a"], "b", True, False, None)]


def test_masks_and_stages(spark):
    turn = "x" + tx.SCAFFOLD
    assert one(spark, tx.masks("t"), t=turn) == 2
    assert one(spark, tx.advance_to_correctness("t", [tx.POS, tx.NEG]), t=turn) == "x Math reasoning: <+>, Consistency: <->, Correctness: <extra>"
    for bad in (tx.advance_to_correctness("t", [tx.POS]), tx.messages(F.lit("a <extra>"), F.col("t"))):
        with pytest.raises(Exception, match="mask"):
            one(spark, bad, t=turn)


@pytest.mark.parametrize(("raw", "most", "want"), [(" a<extra>b ", 0, "a b"), ("abcdef", 3, "abc ..."), ("ab  def", 4, "ab ..."), ("abc", 3, "abc")])
def test_sanitise(spark, raw, most, want):
    assert one(spark, tx.sanitise("t", most), t=raw) == want


def test_reference_block(spark):
    refs = F.array(F.struct(F.lit("q").alias("question"), F.lit("s").alias("step"), F.lit(True).alias("math_ok"), F.lit(False).alias("consistency_ok")))
    out = one(spark, tx.reference_block(refs))
    assert out == tx.REFERENCE_HEADER + "\n\n[Reference 1]\nQuestion: q\nStep: s\nTeacher's judgement: Math reasoning: <+>, Consistency: <-> (consistency error)"
    assert "correct, Consistency: incorrect" in one(spark, tx.reference_block(refs, style="words"))
    assert "judgement" not in one(spark, tx.reference_block(refs, labels=False))
    assert one(spark, tx.reference_block(F.array().cast("array<struct<question:string,step:string,math_ok:boolean,consistency_ok:boolean>>"))) == ""


def test_hashes(spark):
    digest = hashlib.md5(b"0:tok").digest()
    assert one(spark, hash_bucket(F.lit("tok"), dim=1000)) == int.from_bytes(digest[:4], "little") % 1000
    v = one(spark, hashing_vector("t"), t="Ab ab c-d")
    assert len(v) == 256 and sum(v) == 4 and max(v) >= 2
    want = int.from_bytes(hashlib.md5("17\x1fq\x1fs".encode()).digest()[:8], "little") / 2**64
    assert one(spark, unit_hash(F.lit("17"), F.lit("q"), F.lit("s"))) == pytest.approx(want, abs=1e-15)
    v = one(spark, mock_verdict(F.lit("q"), F.lit("s"), F.lit(0)))
    assert (v["math_ok"], v["consistency_ok"]) == (want >= 0.12, want < 0.12 or want >= 0.22)


def test_budget_takes_a_tokenizer(spark):
    @F.pandas_udf("array<int>")
    def words(texts):
        return texts.map(lambda own: [len(t.split()) for t in own])

    refs = [("q one", "s one two", True, True), ("q two", "s three", False, True), ("q", "s " * 50, True, False)]
    df = spark.createDataFrame([("why so", refs, "1 2 3")], "question string, references array<struct<question:string,step:string,math_ok:boolean,consistency_ok:boolean>>, a string")
    own = lambda c: F.transform(c, lambda t: F.size(F.split(F.trim(t), r"\s+")))
    size = [df.select(F.concat(tx.user_turn("go", "question", F.slice("references", F.lit(1), F.lit(k))), F.col("a"))).first()[0] for k in range(4)]
    for budget in (5, len(size[1].split()), len(size[2].split()) + 1, 10_000):
        want = max([k for k in range(4) if len(size[k].split()) <= budget], default=0)
        for tokens in (words, own):
            assert df.select(F.size(tx.fit_references("go", "question", "references", "a", budget, tokens=tokens))).first()[0] == want
