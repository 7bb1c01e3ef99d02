"""Text expressions: question keys, chat parsing, prompts. All native, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens and markers of the grader's prompt format
MASK, POS, NEG = "<extra>", "<+>", "<->"
STEP_MARKER = "Current Step: "
SCAFFOLD = " Math reasoning: <extra>, Consistency: <extra>"
CORRECTNESS = ", Correctness: <extra>"
REFERENCE_HEADER = "\n\nBelow are similar solution steps from other problems that have already been graded by a teacher. Use them as reference for what kinds of mistakes look like.\n"
JUDGEMENT = r"(?U)\s*Math reasoning:\s*(<\+>|<->|<extra>)\s*,\s*Consistency:\s*(<\+>|<->|<extra>)(?:\s*,\s*Correctness:\s*(<\+>|<->|<extra>))?\s*\z"
QUESTION = r"(?sU)Question:\s*(.*)\z"

_SPACE = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x, unicode: bool = True) -> Column:
    """Without white space at both ends, all kinds of it and not blanks alone."""
    u = "(?U)" if unicode else ""
    return F.regexp_replace(_c(x), rf"{u}\A\s+|\s+\z", "")


def normalise_question(x, unicode: bool = True) -> Column:
    """White space collapsed, stripped, lower case. ``unicode=False`` takes ASCII white space only."""
    return F.lower(F.trim(F.regexp_replace(_c(x), _SPACE if unicode else r"\s+", " ")))


def question_id(x, unicode: bool = True) -> Column:
    """First 16 hex digits of the SHA-1 of the normalised question."""
    return F.substring(F.sha1(normalise_question(x, unicode).cast("binary")), 1, 16)


def extract_question(user_turn) -> Column:
    """What follows the first ``Question:``; null if there is none or nothing follows."""
    found = F.when(_c(user_turn).rlike(QUESTION), strip(F.regexp_extract(_c(user_turn), QUESTION, 1)))
    return F.nullif(found, F.lit(""))


def previous_steps(turn, separator: str = "\n\n") -> Column:
    """Steps before the marker, stripped, empty ones left out; null without a marker."""
    turn = _c(turn)
    at = F.locate(STEP_MARKER, turn)
    parts = F.split(F.substr(turn, F.lit(1), at - 1), F.lit("\\Q" + separator + "\\E"))
    return F.when(at > 0, F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != ""))


def current_step(turn) -> Column:
    """The step under judgement without the scaffold; null without a marker or step."""
    turn = _c(turn)
    at = F.locate(STEP_MARKER, turn)
    own = F.substr(turn, at + len(STEP_MARKER))
    return F.nullif(F.when(at > 0, strip(F.regexp_replace(own, JUDGEMENT, ""))), F.lit(""))


def judgement(turn) -> Column:
    """struct(math_ok, consistency_ok, correctness_ok) of a label turn; null unless the first two are filled in."""
    turn = _c(turn)
    token = [F.regexp_extract(turn, JUDGEMENT, k) for k in (1, 2, 3)]
    return F.when(
        token[0].isin(POS, NEG) & token[1].isin(POS, NEG),
        F.struct((token[0] == POS).alias("math_ok"), (token[1] == POS).alias("consistency_ok"), F.when(token[2].isin(POS, NEG), token[2] == POS).alias("correctness_ok")),
    )


def turns_of(turns, role: str) -> Column:
    return F.filter(_c(turns), lambda t: t["role"] == role)


def first_turn(turns, role: str) -> Column:
    return F.get(turns_of(turns, role), F.lit(0))["content"]


def last_turn(turns, role: str) -> Column:
    own = turns_of(turns, role)
    return F.get(own, F.size(own) - 1)["content"]


def masks(x) -> Column:
    """How many mask tokens a text holds."""
    x = _c(x)
    return ((F.length(x) - F.length(F.replace(x, F.lit(MASK), F.lit("")))) / len(MASK)).cast("int")


def sanitise(x, most: int) -> Column:
    """Reference text without masks, of at most ``most`` characters and a mark (0: any length)."""
    clean = strip(F.replace(_c(x), F.lit(MASK), F.lit(" ")))
    if not most:
        return clean
    return F.when(F.length(clean) > most, F.concat(F.regexp_replace(F.left(clean, F.lit(most)), r"(?U)\s+\z", ""), F.lit(" ..."))).otherwise(clean)


def error_type(math_ok, consistency_ok) -> Column:
    math_ok, consistency_ok = _c(math_ok), _c(consistency_ok)
    return F.when(~math_ok & ~consistency_ok, "math and consistency error").when(~math_ok, "math error").when(~consistency_ok, "consistency error").otherwise("no error")


def _block(r: Column, i: Column, most: int = 600, labels: bool = True, style: str = "tokens") -> Column:
    """The i-th reference as prompt text."""
    yes, no = ("correct", "incorrect") if style == "words" else (POS, NEG)
    lines = [F.concat(F.lit("[Reference "), (i + 1).cast("string"), F.lit("]")), F.concat(F.lit("Question: "), sanitise(r["question"], most)), F.concat(F.lit("Step: "), sanitise(r["step"], most))]
    if labels:
        verdict = lambda x: F.when(x, yes).otherwise(no)
        lines.append(F.concat(F.lit("Teacher's judgement: Math reasoning: "), verdict(r["math_ok"]), F.lit(", Consistency: "), verdict(r["consistency_ok"]), F.lit(" ("), error_type(r["math_ok"], r["consistency_ok"]), F.lit(")")))
    return F.concat_ws("\n", *lines)


def reference_block(references, most: int = 600, labels: bool = True, style: str = "tokens") -> Column:
    """References as prompt text; empty without any. ``style`` writes verdicts as ``tokens`` or ``words``."""
    references = _c(references)
    blocks = F.concat(F.array(F.lit(REFERENCE_HEADER)), F.transform(references, lambda r, i: _block(r, i, most, labels, style)))
    return F.when(F.coalesce(F.size(references), F.lit(0)) > 0, F.array_join(blocks, "\n\n")).otherwise("")


def user_turn(prefix: str, question, references=None, **style) -> Column:
    own = F.lit("") if references is None else reference_block(references, **style)
    return F.concat(F.lit(prefix), own, F.lit("\n\n Question: "), _c(question))


def assistant_turn(prev_steps, step) -> Column:
    return F.concat(F.array_join(_c(prev_steps), "\n\n"), F.lit("\n\n" + STEP_MARKER), _c(step), F.lit(SCAFFOLD))


def messages(user, assistant) -> Column:
    """The two turns of a scoring prompt; an error unless the masks are where they have to be."""
    user, assistant = _c(user), _c(assistant)
    own = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))
    return F.when(masks(user) > 0, F.raise_error(F.lit("a mask token stands in the user turn"))).when(masks(assistant) != 2, F.raise_error(F.lit("the assistant turn must hold exactly 2 mask tokens"))).otherwise(own)


def advance_to_correctness(assistant, verdicts: list) -> Column:
    """The second stage's turn: masks filled in one by one, in order, then the correctness scaffold."""
    out = _c(assistant)
    for v in verdicts:
        v = F.lit(v) if isinstance(v, str) else v
        at = F.locate(MASK, out)
        out = F.when(at > 0, F.overlay(out, v, at, F.lit(len(MASK)))).otherwise(out)
    out = F.concat(out, F.lit(CORRECTNESS))
    return F.when(masks(out) != 1, F.raise_error(F.lit("the second stage must hold exactly 1 mask token"))).otherwise(out)


def _lengths(texts: Column) -> Column:
    return F.transform(texts, F.length)


def fit_references(prefix: str, question, references, assistant, budget: int, tokens=_lengths, window: int = 64, **style) -> Column:
    """The longest head of ``references`` whose whole prompt has at most ``budget`` tokens; steps are never cut.

    ``tokens`` counts the tokens of each text of an array column: natively, or as a pandas UDF around a
    tokenizer. The default counts characters. The references beyond the result's size were dropped.

    Each reference is counted once, so the work is linear in them: a prompt's tokens are the sum of its blocks' and,
    for each seam between two blocks, what the ``window`` characters at both sides have together more or less than
    apart. That is exact for tokenizers that part somewhere in these characters whatever follows.
    """
    references, assistant = _c(references), _c(assistant)
    # what the prompt with all references adds to one without any, cut where each reference begins
    head, tail = F.lit(prefix), F.concat(F.lit("\n\n Question: "), _c(question), assistant)
    blocks = F.transform(references, lambda r, i: F.concat(F.when(i == 0, F.lit(REFERENCE_HEADER)).otherwise(F.lit("")), F.lit("\n\n"), _block(r, i, **style)))
    ends = F.concat(F.array(head), blocks)
    seam = lambda x, y: F.array(F.concat(F.right(x, F.lit(window)), F.left(y, F.lit(window))), F.right(x, F.lit(window)), F.left(y, F.lit(window)))
    n = F.size(references)
    between = F.flatten(F.transform(blocks, lambda b, i: seam(ends[i], b)))
    closing = F.flatten(F.transform(ends, lambda e: seam(e, tail)))
    # one call counts everything: head and blocks, the tail, then three texts for each seam
    counted = tokens(F.coalesce(F.concat(ends, F.array(tail), between, closing), F.array().cast("array<string>")))

    def kept(c: Column) -> Column:
        own = lambda at: c[at] - c[at + 1] - c[at + 2]
        upto = F.aggregate(
            F.sequence(F.lit(1), n), F.array(c[0].cast("long")),
            lambda acc, k: F.concat(acc, F.array((F.element_at(acc, -1) + c[k] + own(n + 2 + 3 * (k - 1))).cast("long"))),
        )
        sums = F.when(n > 0, upto).otherwise(F.array(c[0].cast("long")))
        whole = F.transform(sums, lambda x, k: x + c[n + 1] + own(n + 2 + 3 * n + 3 * k))
        return F.coalesce(F.array_max(F.transform(whole, lambda x, k: F.when(x <= budget, k))), F.lit(0))

    return F.when(n >= 0, F.slice(references, F.lit(1), F.transform(F.array(counted), kept)[0]))
