"""Queries over texts: question keys, chat parsing, contexts, prompts, the deterministic scorer, parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.measures import is_error
from ..functions.vectors import mock_verdict
from ..operators import metrics, parity, sequences
from ..sources.config import DEFAULTS
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PREFIX = DEFAULTS["prompt"]["prompt_prefix"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(r"SELECT doc_id, substr(sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 1, 16) AS qid FROM documents")
def qid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.question_id("text", unicode=False).alias("qid"))


_KINDS = "CASE WHEN quality = 0 AND toxic = 1 THEN 'math and consistency error' WHEN quality = 0 THEN 'math error' WHEN toxic = 1 THEN 'consistency error' ELSE 'no error' END"


@query(f"SELECT {_KINDS} AS error_type, count(*) AS n FROM labels GROUP BY 1")
def error_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.groupBy(tx.error_type(F.col("quality") == 1, F.col("toxic") == 0).alias("error_type")).agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT lang AS qid, {_KINDS} AS error_type, coalesce(nullif(source, ''), 'unknown') AS source FROM labels JOIN documents USING (doc_id)) SELECT error_type, source, count(*) AS n_items, count(DISTINCT qid) AS n_questions FROM p GROUP BY GROUPING SETS ((error_type), (source), ())")
def pool_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool statistics in all, by error type and by source, in one pass."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    pool = rows.select(F.col("lang").alias("qid"), (F.col("quality") == 1).alias("math_ok"), (F.col("toxic") == 0).alias("consistency_ok"), "source")
    return metrics.pool_stats(pool).drop("grouping")



@query("SELECT conv_id, turn, count(text) OVER w AS n_prev, md5(coalesce(array_to_string(list(text) OVER w, ' || '), '')) AS prev_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prefix_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the turns before it."""
    rows = sequences.prefix_contexts(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "text")
    return rows.select("conv_id", "turn", F.size("prev_steps").cast("long").alias("n_prev"), F.md5(F.array_join("prev_steps", " || ").cast("binary")).alias("prev_md5"))


@query("WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS step, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, CAST(i AS BIGINT) AS step_index, CAST(i AS BIGINT) AS n_prev, length(step) AS step_chars FROM e")
def explode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as steps, with how many stand before each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("steps"))
    out = sequences.explode_steps(rows)
    return out.select("doc_id", F.col("step_index").cast("long").alias("step_index"), F.size("prev_steps").cast("long").alias("n_prev"), F.char_length("step").cast("long").alias("step_chars"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat rows: turns in order, as an array of (role, content)."""
    own = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(own.alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("inputs"))


_CHAT_SQL = "c AS (SELECT conv_id, arg_min(text, (turn, text)) FILTER (role = 'user') AS question, arg_max(text, (turn, text)) FILTER (role = 'assistant') AS step, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id)"


@query("WITH " + _CHAT_SQL + " SELECT conv_id, md5(question) AS question_md5, md5(step) AS step_md5, n_assistant FROM c")
def conversation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First user turn and last assistant turn of each conversation."""
    rows = _chats(spark, sf_dir)
    md5 = lambda c: F.md5(c.cast("binary"))
    return rows.select("conv_id", md5(tx.first_turn("inputs", "user")).alias("question_md5"), md5(tx.last_turn("inputs", "assistant")).alias("step_md5"), F.size(tx.turns_of("inputs", "assistant")).cast("long").alias("n_assistant"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with both a question and a step, and two references each: the documents with the same and the next number."""
    rows = _chats(spark, sf_dir).select("conv_id", tx.first_turn("inputs", "user").alias("question"), tx.last_turn("inputs", "assistant").alias("step")).where("question IS NOT NULL AND step IS NOT NULL")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "quality", "toxic")
    refs = rows.select("conv_id", F.explode(F.array(F.col("conv_id"), F.col("conv_id") + 1)).alias("doc_id")).join(docs, "doc_id")
    ref = F.struct("doc_id", F.struct(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(80)).alias("question"), F.regexp_replace("text", r"\s+", " ").alias("step"), (F.col("quality") == 1).alias("math_ok"), (F.col("toxic") == 0).alias("consistency_ok")).alias("r"))
    gathered = refs.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(ref)), lambda x: x["r"]).alias("references"))
    return rows.join(gathered, "conv_id", "left")


_VERDICT = "CASE WHEN {} THEN '<+>' ELSE '<->' END"
_BLOCK = (
    "'[Reference ' || rn || ']' || chr(10) || 'Question: ' || trim(left(t, 80)) || chr(10) || 'Step: ' || CASE WHEN length(trim(t)) > 600 THEN rtrim(left(trim(t), 600)) || ' ...' ELSE trim(t) END || chr(10) || 'Teacher''s judgement: Math reasoning: ' || "
    + _VERDICT.format("quality = 1") + " || ', Consistency: ' || " + _VERDICT.format("toxic = 0") + " || ' (' || " + _KINDS + " || ')'"
)
_PROMPT_SQL = _CHAT_SQL + r""", g AS (SELECT * FROM c WHERE question IS NOT NULL AND step IS NOT NULL),
d AS (SELECT conv_id, documents.doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t, quality, toxic FROM g, documents JOIN labels USING (doc_id) WHERE documents.doc_id IN (conv_id, conv_id + 1)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY doc_id) AS rn FROM d),
b AS (SELECT conv_id, string_agg(""" + _BLOCK + ", chr(10) || chr(10) ORDER BY rn) AS body, count(*) AS n FROM e GROUP BY conv_id)," + f"""
m AS (SELECT g.conv_id, question, step, coalesce(n, 0) AS n, {_q(PREFIX)} || CASE WHEN n > 0 THEN {_q(tx.REFERENCE_HEADER)} || chr(10) || chr(10) || body ELSE '' END || chr(10) || chr(10) || ' Question: ' || question AS u,
        chr(10) || chr(10) || 'Current Step: ' || step || {_q(tx.SCAFFOLD)} AS a FROM g LEFT JOIN b USING (conv_id))"""


@query("WITH " + _PROMPT_SQL + " SELECT conv_id, n AS n_references, length(u) AS user_chars, md5(u) AS user_md5, md5(a) AS assistant_md5 FROM m")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring prompts with their references, masks checked."""
    rows = _graded(spark, sf_dir).withColumn("m", tx.messages(tx.user_turn(PREFIX, "question", "references"), tx.assistant_turn(F.array().cast("array<string>"), "step")))
    user, assistant = F.col("m")[0]["content"], F.col("m")[1]["content"]
    return rows.select("conv_id", F.coalesce(F.size("references"), F.lit(0)).cast("long").alias("n_references"), F.char_length(user).cast("long").alias("user_chars"), F.md5(user.cast("binary")).alias("user_md5"), F.md5(assistant.cast("binary")).alias("assistant_md5"))


@query("WITH " + _PROMPT_SQL + f", z AS (SELECT conv_id, a, regexp_replace(regexp_replace(a, '<extra>', '<+>'), '<extra>', '<->') || {_q(tx.CORRECTNESS)} AS s2 FROM m) SELECT conv_id, CAST((length(a) - length(replace(a, '<extra>', ''))) / 7 AS BIGINT) AS masks_1, CAST((length(s2) - length(replace(s2, '<extra>', ''))) / 7 AS BIGINT) AS masks_2, md5(s2) AS stage2_md5 FROM z")
def mask_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask counts of the assistant turn in both stages."""
    rows = _graded(spark, sf_dir).withColumn("a", tx.assistant_turn(F.array().cast("array<string>"), "step")).withColumn("s2", tx.advance_to_correctness("a", [tx.POS, tx.NEG]))
    return rows.select("conv_id", tx.masks("a").cast("long").alias("masks_1"), tx.masks("s2").cast("long").alias("masks_2"), F.md5(F.col("s2").cast("binary")).alias("stage2_md5"))


def _budget_sql(k: int) -> str:
    return f"length({_q(PREFIX)}) + CASE WHEN {k} > 0 AND n >= {k} THEN length({_q(tx.REFERENCE_HEADER)}) + coalesce(" + " + ".join(f"2 + l{i}" for i in range(1, k + 1)) + f", 0) ELSE 0 END + 2 + length(' Question: ') + length(question) + length(a)" if k else f"length({_q(PREFIX)}) + 2 + length(' Question: ') + length(question) + length(a)"


@query("WITH " + _PROMPT_SQL + f""", l AS (SELECT conv_id, max(CASE WHEN rn = 1 THEN length({_BLOCK}) END) AS l1, max(CASE WHEN rn = 2 THEN length({_BLOCK}) END) AS l2 FROM e GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN n >= 2 AND {_budget_sql(2)} <= 2400 THEN 2 WHEN n >= 1 AND {_budget_sql(1)} <= 2400 THEN 1 ELSE 0 END AS BIGINT) AS kept, n AS offered FROM m LEFT JOIN l USING (conv_id)""")
def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references fit a prompt of 2,400 characters."""
    rows = _graded(spark, sf_dir).withColumn("references", F.coalesce("references", F.expr("array()").cast("array<struct<question:string,step:string,math_ok:boolean,consistency_ok:boolean>>")))
    rows = rows.withColumn("a", tx.assistant_turn(F.array().cast("array<string>"), "step"))
    return rows.select("conv_id", F.size(tx.fit_references(PREFIX, "question", "references", "a", 2400)).cast("long").alias("kept"), F.size("references").cast("long").alias("offered"))


_UNIT = "((CAST(('0x' || substr({h}, 15, 2) || substr({h}, 13, 2) || substr({h}, 11, 2) || substr({h}, 9, 2)) AS BIGINT) * 4294967296.0 + CAST(('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2)) AS BIGINT)) / 18446744073709551616.0)"
_MOCK_SQL = _CHAT_SQL + f""", h AS (SELECT conv_id, md5('17' || chr(31) || question || chr(31) || step) AS h1, md5('17' || chr(31) || 'ref' || chr(31) || question || chr(31) || step) AS h2 FROM c WHERE question IS NOT NULL AND step IS NOT NULL),
k AS (SELECT conv_id, least(greatest({_UNIT.format(h="h1")} + 0.35 * 2 * ({_UNIT.format(h="h2")} - 0.5), 0.0), 1.0) AS score FROM h)"""


@query("WITH " + _MOCK_SQL + " SELECT conv_id, score >= 0.12 AS math_ok, score < 0.12 OR score >= 0.22 AS consistency_ok, round(CASE WHEN score >= 0.22 THEN score END, 6) AS correctness_prob, score < 0.5 AS is_error FROM k")
def mock_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic scorer's verdicts, with two references each."""
    rows = _chats(spark, sf_dir).select("conv_id", tx.first_turn("inputs", "user").alias("question"), tx.last_turn("inputs", "assistant").alias("step")).where("question IS NOT NULL AND step IS NOT NULL")
    out = rows.select("conv_id", mock_verdict("question", "step", F.lit(2)).alias("v")).select("conv_id", "v.*")
    return out.select("conv_id", "math_ok", "consistency_ok", F.round("correctness_prob", 6).alias("correctness_prob"), is_error("math_ok", "consistency_ok", "correctness_prob").alias("is_error"))


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT user_id, coalesce(min(CASE WHEN event_type = 'error' THEN i END), -1) AS first_error, count(*) AS n_events FROM t GROUP BY user_id")
def event_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error event of each user's sequence."""
    rows = sequences.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])
    out = sequences.first_error(rows.withColumn("is_error", F.col("event_type") == "error"), "user_id")
    return out.select("user_id", F.col("predicted_label").cast("long").alias("first_error"), F.col("n_steps").alias("n_events"))


@query("""WITH a AS (SELECT 'data' AS section, n_name AS key, CAST(count(c_custkey) AS VARCHAR) AS value FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name),
b AS (SELECT 'data' AS section, n_name AS key, CAST(count(s_suppkey) AS VARCHAR) AS value FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT section, key, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b USING (section, key) WHERE a.value IS DISTINCT FROM b.value""")
def parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parity gate's null-safe diff, over nations' customers and suppliers as two configurations."""
    nation = table(spark, sf_dir, "nation")
    side = lambda t, k, i: table(spark, sf_dir, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count(i).alias("n")).join(nation, "n_nationkey").select(F.lit("data").alias("section"), F.col("n_name").alias("key"), F.col("n").cast("string").alias("value"))
    return parity.diff(side("customer", "c_nationkey", "c_custkey"), side("supplier", "s_nationkey", "s_suppkey"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and difference of uid sets."""
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").union(labels.where("quality = 0").select("doc_id")).distinct().exceptAll(labels.where("toxic = 1").select("doc_id").distinct())


