"""Operator 3: personal data by weak supervision.

Candidates are the base spans (strict patterns with their checks), strict matches that fail their check,
and looser forms of the same kinds: numbers without a plus, in other digits or separators or spelled out,
addresses with blanks or written around filters. Labelers vote on each candidate (for, against or not at
all): its kind's check, a gazetteer of the kind, the words before it, and what it is glued to. Votes meet
as counts of vote patterns, a small table whatever the corpus; expectation-maximisation over it estimates how
reliable each labeler is. Base spans are known to be true there, and what fails its kind's check (Luhn, lengths,
ranges) to be false, so that both classes have examples; looser forms that pass are open. The posteriors train the final span classifier, a logistic
model over votes and span features. Base spans always stay; the classifier decides on the others.

Spans are in code points, the end exclusive. Per kind they don't overlap (of other candidates the leftmost
stays), and a candidate that overlaps any base span is left out.

Defined cases: a null text has no spans; a text of any length is read whole, in time linear in it; rows
that repeat are read each for itself; a kind without candidates gets no classifier and no added span;
other columns are not read, and kept columns with the name of a result are refused.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import refuse_clashes, sliced, spread, table

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.5
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the looks behind keep runs of digits from being tried again from their middle; they exclude no match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: digits, signs and blanks of other alphabets, each with the ASCII character it stands for
_PLAIN = {**{first + k: 48 + k for first in (0xFF10, 0x0660, 0x06F0, 0x0966) for k in range(10)}, 0xFF20: 64, 0xFF0E: 46, 0xFF0B: 43, **dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0xFF0D), 45), **dict.fromkeys((0xA0, 0x2009, 0x202F, 0x3000), 32)}
_OTHER = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")
_SPELLED = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890", strict=True))
_SPELLED_ONE = "(?:" + "|".join(_SPELLED) + ")"
_SPELLED_RUN = re.compile(rf"\b{_SPELLED_ONE}(?:[ -]{_SPELLED_ONE}){{6,}}\b", re.IGNORECASE)
_HINTS = (" one ", " two ", " three ", " four ", " five ", " six ", " seven ", " eight ", " nine ", " zero ", " oh ", "-one-", "-two-", "-three-", "-four-", "-five-", "-six-", "-seven-", "-eight-", "-nine-", "-zero-", "-oh-")
_NAME = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
_LOOSE = {
    "email": (
        re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|@) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|\.) ?[\])]) ?[A-Za-z0-9-]{1,63}){1,6}", re.IGNORECASE),
        re.compile(_NAME + r" (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}){1,6}"),
        re.compile(_NAME + r"(?: @ ?| ?@ )[A-Za-z0-9-]{1,63}(?:(?:\.| \. )[A-Za-z0-9-]{1,63}){1,6}"),
    ),
    "ip": (re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| \. )[0-9]{1,3}){3}(?![0-9])"),),
    "card": (re.compile("(?<![0-9])[0-9]{4}([. –_]| - |  )[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}(?![0-9])"), re.compile("(?<![0-9])[0-9]{4}([._]| - |  )[0-9]{6}\\1[0-9]{5}(?![0-9])")),
    "phone": (
        re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"),
        re.compile(r"(?<![0-9+.,-])00[1-9][0-9]{0,2}(?:[ /-][0-9]{2,5}){2,5}(?![0-9]|[.,-][0-9])"),
        re.compile(r"(?<![0-9+.,-])0[1-9][0-9]{1,4}[ /-][0-9]{3,5}(?:[ -][0-9]{2,5}){0,3}(?![0-9]|[.,-][0-9])"),
    ),
}
#: an address without a dot after its @: what a strict email needs and lacks
_DOTLESS = re.compile(_NAME + r"@[A-Za-z0-9-]{1,63}(?![A-Za-z0-9-]|\.[A-Za-z0-9-])")
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel|write|reach)\b", re.IGNORECASE),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|from)\b", re.IGNORECASE),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|pay(?:ment)?|tarjeta|karte|carte)\b", re.IGNORECASE),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|fax|mobile|cell|telefon|tel[eé]fono)\b", re.IGNORECASE),
}
_AGAINST = re.compile(r"\b(?:version|ver|v|release|build|isbn|issn|doi|sha|hash|token|order|invoice|sku|part|section|chapter)\b\W*$", re.IGNORECASE)
#: top-level domains of the gazetteer; two-letter ones are all taken as countries
_TLD = frozenset("com org net edu gov mil int info biz name io dev app".split())
#: leading digits and lengths of common card issuers
_ISSUERS = ((re.compile(r"4"), (13, 16, 19)), (re.compile(r"5[1-5]|2[2-7]"), (16,)), (re.compile(r"3[47]"), (15,)), (re.compile(r"6"), (16, 17, 18, 19)), (re.compile(r"3[0689]|35"), (14, 15, 16, 17, 18, 19)))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def base_spans(text: str, failed: list | None = None) -> list[tuple[str, int, int]]:
    """The spans of the strict patterns that pass their checks, by kind and start; ``failed`` takes those that are near but fail."""
    out: list[tuple[str, int, int]] = []
    miss = [] if failed is None else failed
    at, end = text.find("@"), 0
    while at >= 0:  # the part before each @ is the run of its characters that ends there
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            (out if _octets(m[0].split(".")) else miss).append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19:
                (out if luhn(d) else miss).append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            n = len(_digits(m[0]))
            if 9 <= n <= 15:
                out.append(("phone", *m.span()))
            elif 5 <= n <= 20:
                miss.append(("phone", *m.span()))
    return out


def _loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The other candidates that meet no span of ``base``: strict matches that fail their check, and looser forms."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", *m.span()) for m in _DOTLESS.finditer(text))
    some = bool(_DIGIT.search(text))
    if some:
        base_spans(text, found)
    if _OTHER.search(text):  # one character for each, so places stay
        there = set(base_spans(text))
        found += (s for s in base_spans(text.translate(_PLAIN)) if s not in there)
    marks = "[" in text or "(" in text, " dot " in text or " DOT " in text, "@ " in text or " @" in text
    tries = [("email", p) for p, use in zip(_LOOSE["email"], marks, strict=True) if use] + [(kind, p) for kind in ("ip", "card", "phone") if some for p in _LOOSE[kind]]
    low = text.lower()
    if any(h in low for h in _HINTS):
        tries.append(("phone", _SPELLED_RUN))
    for kind, pattern in tries:
        found += ((kind, *m.span()) for m in pattern.finditer(text) if kind != "ip" or _octets(re.findall(r"[0-9]+", m[0])))
    # the union of the base spans, as places in order where it begins and ends
    edges: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if edges and a <= edges[-1]:
            edges[-1] = max(edges[-1], b)
        else:
            edges += (a, b)
    out, last = [], dict.fromkeys(KINDS, 0)
    for kind, a, b in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], -s[2])):
        if a >= last[kind]:
            last[kind] = b
            at = bisect_right(edges, a)  # odd inside the union
            if at % 2 == 0 and (at == len(edges) or edges[at] >= b):
                out.append((kind, a, b))
    return out


def _plain_digits(own: str) -> str:
    """The digits of a candidate, those of other alphabets and spelled ones too."""
    found = _digits(own.translate(_PLAIN))
    return found or "".join(_SPELLED.get(w, "") for w in re.split("[ -]", own.lower()))


def _vote(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Votes of the pattern's check, the gazetteer, the context and the boundary: 1 for, -1 against, 0 none."""
    own, left, right = text[start:end], text[max(0, start - 30) : start], text[end : end + 1]
    digits = _plain_digits(own)
    if kind == "email":
        labels = [w for w in re.split(r"[^A-Za-z0-9-]+", own.translate(_PLAIN).rstrip("])")) if w]
        last = labels[-1].lower()
        check = last.isalpha() and len(last) > 1 and not labels[-2].endswith("-") if len(labels) > 2 else False
        known = last in _TLD or len(last) == 2 and last.isalpha()
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", own.translate(_PLAIN))
        check = _octets(parts)
        first, most = int(parts[0][-9:]), max(int(p[-9:]) for p in parts)
        known = first not in (0, 127, 255) and not (first < 10 and most < 20)
    elif kind == "card":
        check = 13 <= len(digits) <= 19 and luhn(digits)
        known = any(p.match(digits) and len(digits) in n for p, n in _ISSUERS)
    else:
        check = 9 <= len(digits) <= 15
        known = (digits[1:4] if own[0] == "+" and digits[:1] == "1" else digits)[:3] not in ("000", "") and len(set(digits)) > 2
    context = -1 if _AGAINST.search(left) else 1 if _CUES[kind].search(left) else 0
    glued = bool(left) and (left[-1].isalnum() or left[-1] in "\"'=/#_") or bool(right) and (right.isalnum() or right in "\"'=/#_")
    return 1 if check else -1, 1 if known else -1, context, -1 if glued else 1


def _features(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Small features besides votes: class of length, separators, start and end of a word."""
    own = text[start:end]
    return min(7, (end - start) // 5), int(any(c in " ().-" for c in own)), int(start == 0 or text[start - 1].isspace()), int(end == len(text) or text[end].isspace())


def candidates(text: str):
    """(kind, start, end, truth, votes, features) of all candidates of a text: truth is 1 for base spans, 0 for others that fail their kind's check, -1 for those still open."""
    base = base_spans(text)
    for kind, a, b in base:
        yield kind, a, b, 1, _vote(kind, text, a, b), _features(kind, text, a, b)
    for kind, a, b in _loose_spans(text, base):
        votes = _vote(kind, text, a, b)
        yield kind, a, b, 0 if votes[0] < 0 else -1, votes, _features(kind, text, a, b)


#: share of all candidates that each labeler is taken to be right about beforehand, whatever the votes
RIGHT = 0.1


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 100, truths: list[int] | None = None) -> tuple[float, list[dict], list[float]]:
    """Expectation-maximisation over (votes, count): the prior, each labeler's vote rates given both truths, and posteriors.

    It starts from the share of votes for; a labeler's rates are smoothed by one count each, and by the share ``RIGHT``
    of all candidates for right votes. Patterns whose entry of ``truths`` is 0 or 1 keep that as their posterior; the
    first labeler decided these truths, so its rates, and the prior, are of the open patterns (-1) alone.
    """
    n = len(patterns[0][0])
    truths = truths or [-1] * len(patterns)
    fixed = lambda post: [float(t) if t >= 0 else p for p, t in zip(post, truths, strict=True)]
    post = fixed([(1 + sum(v > 0 for v in votes)) / (2 + sum(v != 0 for v in votes)) for votes, _ in patterns])
    prior, rates = 0.5, []
    for _ in range(rounds):
        weight = sum(c for _, c in patterns)
        free, decided = [(p, c) for p, (_, c), t in zip(post, patterns, truths, strict=True) if t < 0], max(truths) >= 0
        prior = min(0.99, max(0.01, (1 + sum(p * c for p, c in free)) / (2 + sum(c for _, c in free))))
        rates = []
        for k in range(n):
            table = {(t, v): 1.0 + (RIGHT * (sum(c for _, c in free) if decided and k == 0 else weight) if v == 2 * t - 1 else 0) for t in (0, 1) for v in (-1, 0, 1)}
            for p, (votes, c), t in zip(post, patterns, truths, strict=True):
                if k == 0 and t >= 0:
                    continue
                table[1, votes[k]] += p * c
                table[0, votes[k]] += (1 - p) * c
            rates.append({(t, v): x / sum(table[t, u] for u in (-1, 0, 1)) for (t, v), x in table.items()})
        new = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[k][1, v] / rates[k][0, v]) for k, v in enumerate(votes))
            new.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
        new = fixed(new)
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-6
        post = new
        if done:
            break
    return prior, rates, post


def _vector(votes: tuple[int, ...], features: tuple[int, ...]) -> list[float]:
    length, *flags = features
    return [1.0, *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), *map(float, flags), *(float(length == k) for k in range(8))]


def fit(rows: list[tuple[int, tuple[int, ...], tuple[int, ...], float]], rounds: int = 50, ridge: float = 1.0) -> list[float]:
    """Weights of the span classifier from (truth, votes, features, count), by Newton steps on the posteriors of :func:`estimate`."""
    import numpy as np

    counts: Counter = Counter()
    for truth, votes, _, c in rows:
        counts[truth, votes] += c
    keys = sorted(counts)
    post = dict(zip(keys, estimate([(votes, counts[truth, votes]) for truth, votes in keys], truths=[truth for truth, _ in keys])[2], strict=True))
    x = np.array([_vector(v, f) for _, v, f, _ in rows])
    y = np.array([post[t, v] for t, v, *_ in rows])
    c = np.array([c for *_, c in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (c * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, text: str = "text") -> dict[str, list[float]]:
    """Classifier weights by kind, from the vote patterns of all of ``docs``."""

    def run(it):
        import pyarrow as pa

        seen: Counter = Counter()
        for b in sliced(it):
            for t in b.column(text).to_pylist():
                for kind, _, _, truth, votes, features in candidates(t or ""):
                    seen[kind, truth, votes, features] += 1
        kinds, truths, votes, features = zip(*seen, strict=True) if seen else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(truths, pa.int32()), pa.array(votes, pa.list_(pa.int32())), pa.array(features, pa.list_(pa.int32())), pa.array([*seen.values()], pa.int64())], names=["kind", "truth", "votes", "features", "n"])

    # at most kinds x 3 x 3**labelers x 64 features rows
    rows = docs.select(text).mapInArrow(run, "kind string, truth int, votes array<int>, features array<int>, n long").groupBy("kind", "truth", "votes", "features").agg(F.sum("n").alias("n")).collect()
    out = {}
    for kind in KINDS:
        if own := sorted((r["truth"], tuple(r["votes"]), tuple(r["features"]), float(r["n"])) for r in rows if r["kind"] == kind):
            out[kind] = fit(own)
    return out


def spans(text: str, model: dict[str, list[float]], accept: float = ACCEPT) -> tuple[list, list]:
    """(base spans, all spans) of a text, each as (kind, start, end) by kind as listed and start."""
    base, more = [], []
    for kind, a, b, truth, votes, features in candidates(text):
        if truth == 1:
            base.append((kind, a, b))
        elif kind in model:
            z = sum(w * x for w, x in zip(model[kind], _vector(votes, features), strict=True))
            if 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) >= accept:
                more.append((kind, a, b))
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + more, key=order)


def _written(own: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in own)


def find_pii(docs: DataFrame, model: dict[str, list[float]], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, counts of base spans by kind, base_sha256 and spans; one pass without a shuffle."""
    refuse_clashes(keep, (*(f"n_{k}" for k in KINDS), "base_sha256", "spans"))
    own = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*own.select(*keep).schema.fields, *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(it):
        import pyarrow as pa

        for b in sliced(it):
            found = [spans(t or "", model) for t in b.column(text).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            hashes = pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *counts, hashes, pa.array([_written(x) for _, x in found], pa.string())], names=schema.names)

    return own.mapInArrow(run, schema)


def redact(docs: DataFrame, model: dict[str, list[float]], text: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by the kind in angle brackets."""

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for kind, a, b in sorted(spans(t, model)[1], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [t[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(clean)

    return docs.withColumn(text, cleaned(text))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return find_pii(docs, learn(docs), ["doc_id"])
