"""Queries over what stands before and after scoring: benchmark rows, chat rows, indexes, predictions, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import dot, hashing_vector
from ..operators import contrast, encode, metrics
from ..operators.score import score_mock
from ..operators.sequences import explode_steps, predictions
from ..sources import benchmark, pool, runs
from ..sources.config import resolve
from .evaluation import evaluate
from .evaluation_queries import _SCORED, _r
from .tables import ARMS_SQL, F1_SQL, RANKS, SOLUTIONS_SQL, arm, both_arms, severity_sql, solutions, table
from .text_queries import _BLOCK, _PROMPT_SQL, _UNIT, PREFIX, _graded, _q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def _solutions_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw benchmark rows: lines are steps, labels go round, every third row has an empty id."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("steps", F.split("text", "\n"))
    raw = rows.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("d"), F.col("doc_id"))).alias("id"), F.coalesce("source", F.lit("")).alias("problem"), "steps",
        (F.col("doc_id") % (F.size("steps") + 1) - 1).alias("label"), (F.col("doc_id") % 2 == 0).alias("final_answer_correct"), F.lit("none").alias("generator"),
    )
    return benchmark.normalise(raw, "documents", "doc_id")


_RAW_SQL = "b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'documents-' || doc_id ELSE 'd' || doc_id END AS uid, coalesce(source, '') AS problem, string_split(coalesce(text, ''), chr(10)) AS steps, doc_id FROM documents), n AS (SELECT *, doc_id % (len(steps) + 1) - 1 AS label FROM b)"


@query("WITH " + _RAW_SQL + " SELECT uid, 'documents' AS subset, md5(problem) AS problem_md5, md5(array_to_string(steps, '|')) AS steps_md5, CAST(label AS BIGINT) AS label, doc_id % 2 = 0 AS final_answer_correct FROM n")
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as solutions: ids filled in by position, labels checked against their steps."""
    rows = _solutions_of_documents(spark, sf_dir)
    return rows.select("uid", "subset", _md5(F.col("problem")).alias("problem_md5"), _md5(F.array_join("steps", "|")).alias("steps_md5"), F.col("label").cast("long").alias("label"), "final_answer_correct")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(r"""WITH c AS (SELECT conv_id, arg_min(text, (turn, text)) FILTER (role = 'user') AS question, arg_max(text, (turn, text)) FILTER (role = 'assistant') AS step, list(text ORDER BY turn, text) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, """ + _STRIP.format("question") + " AS question, " + _STRIP.format("step") + """ AS step, list_filter(list_transform(string_split(array_to_string(list_slice(said, 1, len(said) - 1), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: """ + _STRIP.format("x") + r"""), lambda x: x <> '') AS prev FROM c)
SELECT conv_id, substr(sha1(lower(trim(regexp_replace(question, '\s+', ' ', 'g')))), 1, 16) AS qid, md5(question) AS question_md5, md5(step) AS step_md5, CAST(len(prev) AS BIGINT) AS n_prev, md5(array_to_string(prev, '|')) AS prev_md5,
conv_id % 2 = 0 AS math_ok, conv_id % 3 = 0 AS consistency_ok, CASE WHEN conv_id % 4 < 2 THEN conv_id % 4 = 0 END AS correctness_ok FROM s WHERE question <> '' AND step <> ''""")
def chat_rows_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as graded chat rows (question, earlier steps, step with its scaffold, verdicts) and parsed back."""
    own = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(own.alias("t"))
    of = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: x["text"])
    rows = rows.select("conv_id", F.get(of("user"), F.lit(0)).alias("question"), of("assistant").alias("said")).where("question IS NOT NULL AND size(said) > 0")
    rows = rows.withColumns({"prev": F.slice("said", F.lit(1), F.greatest(F.size("said") - 1, F.lit(0))), "step": F.get("said", F.size("said") - 1)})
    token = lambda c: F.when(c, tx.POS).otherwise(tx.NEG)
    k = F.col("conv_id")
    verdict = F.concat(F.lit(" Math reasoning: "), token(k % 2 == 0), F.lit(", Consistency: "), token(k % 3 == 0), F.when(k % 4 < 2, F.concat(F.lit(", Correctness: "), token(k % 4 == 0))).otherwise(""))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    asked = tx.assistant_turn("prev", "step")
    chats = rows.select("conv_id", F.array(turn("user", tx.user_turn(PREFIX, "question")), turn("assistant", asked)).alias("inputs"), F.array(turn("assistant", F.concat("step", verdict))).alias("labels"), F.lit("made").alias("source"))
    out = pool.parse_rows(chats)
    return out.select(
        "conv_id", "qid", _md5(F.col("question")).alias("question_md5"), _md5(F.col("step")).alias("step_md5"), F.size("prev_steps").cast("long").alias("n_prev"),
        _md5(F.array_join("prev_steps", "|")).alias("prev_md5"), "math_ok", "consistency_ok", "correctness_ok",
    )


@query("WITH " + _RAW_SQL + f""", e AS (SELECT uid, label, problem, unnest(steps) AS step, generate_subscripts(steps, 1) - 1 AS i FROM n),
h AS (SELECT uid, label, i, md5('17' || chr(31) || problem || chr(31) || step) AS h FROM e), k AS (SELECT uid, label, i, {_UNIT.format(h="h")} AS score FROM h),
p AS (SELECT uid, label, count(*) AS n_steps, coalesce(min(CASE WHEN score < 0.5 THEN i END), -1) AS predicted, arg_min(CASE WHEN score < 0.12 THEN 'math error' WHEN score < 0.22 THEN 'consistency error' ELSE 'no error' END, i) FILTER (score < 0.5) AS kind FROM k GROUP BY uid, label)
SELECT uid, CAST(label AS BIGINT) AS gold_label, CAST(predicted AS BIGINT) AS predicted_label, n_steps, CASE WHEN predicted >= 0 THEN predicted + 1 ELSE n_steps END AS n_steps_scored, kind AS predicted_error_type, label = predicted AS correct FROM p""")
def mock_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as solutions, their lines scored without references: one prediction each, as a run writes them."""
    steps = explode_steps(_solutions_of_documents(spark, sf_dir)).withColumnsRenamed({"label": "gold_label", "problem": "question"})
    out = predictions(score_mock(steps, prefix=PREFIX))
    whole = [F.col(c).cast("long").alias(c) for c in ("gold_label", "predicted_label", "n_steps", "n_steps_scored")]
    return out.select("uid", *whole, "predicted_error_type", "correct")


@query("WITH " + _RAW_SQL + f""", e AS (SELECT uid, label, problem, unnest(steps) AS step, generate_subscripts(steps, 1) - 1 AS i FROM n),
h AS (SELECT uid, label, i, md5('17' || chr(31) || problem || chr(31) || step) AS h FROM e), k AS (SELECT uid, label, i, {_UNIT.format(h="h")} AS score FROM h),
f AS (SELECT *, min(CASE WHEN score < 0.5 THEN i END) OVER (PARTITION BY uid) AS first FROM k)
SELECT uid, CAST(i AS BIGINT) AS step_index, CAST(label AS BIGINT) AS gold_label, score < 0.5 AS is_error, score >= 0.12 AS math_ok, score < 0.12 OR score >= 0.22 AS consistency_ok, round(CASE WHEN score >= 0.22 THEN score END, 9) AS correctness_prob,
CASE WHEN score < 0.12 THEN 'math error' WHEN score < 0.22 THEN 'consistency error' ELSE 'no error' END AS error_type, 0 AS n_references FROM f WHERE first IS NULL OR i <= first""")
def run_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces of a run without references over documents as solutions: each up to its first flag."""
    config = resolve({"prm": {"backend": "mock"}, "retrieval": {"enabled": False}})
    rows = evaluate(_solutions_of_documents(spark, sf_dir), config)[1]
    whole = [F.col(c).cast("long").alias(c) for c in ("step_index", "gold_label")]
    return rows.select("uid", *whole, "is_error", "math_ok", "consistency_ok", F.round("correctness_prob", 9).alias("correctness_prob"), "error_type", "n_references")


_HASHED_SQL = "SELECT doc_id, CAST(('0x' || substr(md5('0:' || tok), 1, 2)) AS BIGINT) AS bucket, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents) GROUP BY ALL"


@query(_HASHED_SQL)
def hashing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashing encoder's vectors of whole documents, as their non-zero entries."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(hashing_vector("text")).alias("bucket", "n"))
    return rows.where("n > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.col("n").cast("long").alias("n"))


@query("WITH i AS (" + _HASHED_SQL.replace("SELECT doc_id, unnest", "SELECT 'i' || doc_id AS doc_id, unnest") + """),
t AS (SELECT DISTINCT coalesce(lang, '') || ' ' || coalesce(source, '') AS question FROM documents),
q AS (SELECT 'q' || question AS doc_id, CAST(('0x' || substr(md5('0:' || tok), 1, 2)) AS BIGINT) AS bucket, count(*) AS n FROM (SELECT question, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS tok FROM t) GROUP BY ALL),
x AS (SELECT * FROM i UNION ALL SELECT * FROM q), m AS (SELECT bucket, sum(n) / ((SELECT count(*) FROM documents) + (SELECT count(*) FROM t)) AS m FROM x GROUP BY bucket), mm AS (SELECT sum(m * m) AS mm FROM m),
s AS (SELECT doc_id, sum(CAST(n AS DOUBLE) * n) AS xx, sum(n * m) AS xm FROM x JOIN m USING (bucket) GROUP BY doc_id),
d AS (SELECT documents.doc_id, 'i' || documents.doc_id AS i, 'q' || coalesce(lang, '') || ' ' || coalesce(source, '') AS q FROM documents),
c AS (SELECT d.doc_id, d.i, d.q, coalesce((SELECT sum(CAST(a.n AS DOUBLE) * b.n) FROM i a JOIN q b USING (bucket) WHERE a.doc_id = d.i AND b.doc_id = d.q), 0) AS xy FROM d)
SELECT c.doc_id, round((xy - coalesce(a.xm, 0) - coalesce(b.xm, 0) + mm) / sqrt((coalesce(a.xx, 0) - 2 * coalesce(a.xm, 0) + mm) * (coalesce(b.xx, 0) - 2 * coalesce(b.xm, 0) + mm)), 6) AS similarity
FROM c CROSS JOIN mm LEFT JOIN s a ON a.doc_id = c.i LEFT JOIN s b ON b.doc_id = c.q""")
def index_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over documents with all principal axes: each item's cosine with its own question.

    A projection onto all axes only turns the centred vectors, so SQL can say what the cosines have to be.
    """
    docs = table(spark, sf_dir, "documents")
    question = F.concat_ws(" ", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    items = docs.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ordinal"), question.alias("qid"), question.alias("question"), F.coalesce("text", F.lit("")).alias("step"))
    questions, steps, _ = encode.build_index(items, "hashing", 256)
    both = steps.select("item_id", "qid", F.col("vec").alias("s")).join(questions.select("qid", F.col("vec").alias("q")), "qid")
    return both.select(F.col("item_id").alias("doc_id"), F.round(dot("s", "q"), 6).alias("similarity"))


@query("WITH m AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), g AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(CAST(x AS DOUBLE)) AS a FROM m GROUP BY i)), c AS (SELECT vec_id, list_transform(list_zip(embedding, mean), lambda p: CAST(p[1] AS DOUBLE) - p[2]) AS v FROM embeddings, g) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM c a JOIN c b ON b.vec_id = a.vec_id + 1")
def projected_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on all their principal axes: each one's cosine with the next, which no sign of an axis changes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    width = rows.agg(F.max(F.size("vec"))).first()[0]
    turned = encode.apply_projection(rows, encode.fit_projection(rows, width))
    after = turned.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("after"))
    return turned.join(after, "vec_id").select("vec_id", F.round(dot("vec", "after"), 6).alias("similarity"))


@query("WITH " + SOLUTIONS_SQL + """, c AS (SELECT subset, count(*) FILTER (pred_b = gold_label AND pred_a <> gold_label) AS b, count(*) FILTER (pred_a = gold_label AND pred_b <> gold_label) AS a FROM j GROUP BY subset),
z AS (SELECT subset, a + b AS n, CASE WHEN a + b = 0 THEN 0.0 ELSE abs(abs(b - a) - 1) / sqrt(a + b) / sqrt(2.0) END AS z FROM c),
t AS (SELECT subset, any_value(n) AS n, sum(exp(-power(z * k / 2000.0, 2)) * CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * any_value(z) / 6000.0 AS area FROM z, (SELECT range AS k FROM range(2001)) GROUP BY subset)
SELECT subset, round(CASE WHEN n = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * area END, 6) AS p_value FROM t""")
def mcnemar_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """McNemar's p-values by subset; SQL integrates the normal density by Simpson's rule."""
    rows = solutions(spark, sf_dir).select("subset", F.col("gold_label").alias("gold"), "pred_a", "pred_b")
    return contrast.mcnemar(rows, ("subset",)).select("subset", _r("p_value"))


@query("WITH " + ARMS_SQL + f""", m AS (SELECT arm, subset, {_SCORED.format(p='predicted_label')} FROM r GROUP BY arm, subset), v AS (SELECT arm, subset, {F1_SQL} AS f FROM m), d AS (SELECT avg(f) FILTER (arm = 'a') AS fa, avg(f) FILTER (arm = 'b') AS fb FROM v),
p AS (SELECT count(*) AS n, count(*) FILTER (pred_b = gold_label AND pred_a <> gold_label) AS b_only, count(*) FILTER (pred_a = gold_label AND pred_b <> gold_label) AS a_only FROM j)
SELECT n AS n_solutions, round(fa, 6) AS average_f1_a, round(fb, 6) AS average_f1_b, round(fb - fa, 6) AS average_delta, b_only, a_only, CASE WHEN b_only + a_only > 0 THEN b_only + a_only >= 25 END AS reliable FROM d, p""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a comparison of two runs; its intervals are drawn at random and tested apart."""
    rows = solutions(spark, sf_dir)
    found = contrast.compare(arm(rows, "a"), arm(rows, "b"))
    pooled = found["overall"]["mcnemar_pooled"]
    values = (found["overall"]["n_solutions"], *(round(found[c], 6) for c in ("average_f1_a", "average_f1_b", "average_delta")), pooled["b_only"], pooled["a_only"], pooled["reliable"])
    return spark.createDataFrame([values], "n_solutions long, average_f1_a double, average_f1_b double, average_delta double, b_only long, a_only long, reliable boolean")


@query("WITH " + ARMS_SQL + f", k AS (SELECT * FROM r WHERE subset <> '1-URGENT' OR gold_label <> -1 OR arm = 'b'), m AS (SELECT arm, subset, {_SCORED.format(p='predicted_label')} FROM k GROUP BY arm, subset), g AS (SELECT arm, subset, {severity_sql()} AS ood_rank, {F1_SQL} AS f1 FROM m) SELECT arm, subset, CAST(ood_rank AS BIGINT) AS ood_rank, round(f1, 6) AS f1 FROM g WHERE subset NOT IN (SELECT subset FROM g WHERE f1 IS NULL)")
def arms_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chart of arms shows; one subset's F1 is undefined in one arm, so it is left out of all."""
    rows = both_arms(solutions(spark, sf_dir)).where((F.col("subset") != "1-URGENT") | (F.col("gold_label") != -1) | (F.col("arm") == "b"))
    out = metrics.comparable_scores(metrics.score_subsets(rows, by=("arm",)), ranks=RANKS)
    return out.select("arm", "subset", F.col("ood_rank").cast("long").alias("ood_rank"), _r("f1"))


@query("WITH " + SOLUTIONS_SQL + " SELECT uid, subset, CAST(pred_a AS BIGINT) AS predicted_label FROM j WHERE o_totalprice > 50000 AND o_orderstatus <> 'P'")
def wanted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's predictions of the wanted solutions: both uid and subset have to match."""
    rows = solutions(spark, sf_dir)
    wanted = table(spark, sf_dir, "orders").where("o_totalprice > 50000").select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderstatus") == "P", "another").otherwise(F.col("o_orderpriority")).alias("subset"))
    return runs.wanted(arm(rows, "a"), wanted).select("uid", "subset", F.col("predicted_label").cast("long").alias("predicted_label"))


_WORDS = r"len(regexp_split_to_array({}, '\s+'))"
_USER = f"{_q(PREFIX)} || {{}} || chr(10) || chr(10) || ' Question: ' || question"
_SOME = f"{_q(tx.REFERENCE_HEADER)} || chr(10) || chr(10) || "


@query("WITH " + _PROMPT_SQL + f""", l AS (SELECT conv_id, count(*) AS k, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rn) FILTER (rn = 1) AS b1, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rn) AS b2 FROM e GROUP BY conv_id),
w AS (SELECT conv_id, n, {_WORDS.format(_USER.format(_SOME + "b1") + " || a")} AS w1, {_WORDS.format(_USER.format(_SOME + "b2") + " || a")} AS w2 FROM m LEFT JOIN l USING (conv_id)),
k AS (SELECT conv_id, n, CASE WHEN n >= 2 AND w2 <= 420 THEN 2 WHEN n >= 1 AND w1 <= 420 THEN 1 ELSE 0 END AS kept FROM w)
SELECT conv_id, CAST(kept AS BIGINT) AS kept, CAST(n - kept AS BIGINT) AS dropped FROM k""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that fit a prompt of 420 tokens, and those that don't, with words as the tokens."""
    rows = _graded(spark, sf_dir).withColumn("references", F.coalesce("references", F.expr("array()").cast("array<struct<question:string,step:string,math_ok:boolean,consistency_ok:boolean>>")))
    rows = rows.withColumn("a", tx.assistant_turn(F.array().cast("array<string>"), "step"))
    kept = F.size(tx.fit_references(PREFIX, "question", "references", "a", 420, tokens=lambda texts: F.transform(texts, lambda t: F.size(F.split(t, r"\s+")))))
    return rows.select("conv_id", kept.cast("long").alias("kept"), (F.size("references") - kept).cast("long").alias("dropped"))
