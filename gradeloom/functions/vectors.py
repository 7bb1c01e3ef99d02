"""Dense vectors as arrays, the hashing encoder and the deterministic scorer; dense products in Arrow batches, the rest natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it for each element of an array."""
    return F.transform(F.array(value), use)[0]


def l2_normalise(v) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.greatest(l2_norm(v), F.lit(1e-12))
    return bound(F.struct(_c(v).alias("v"), norm.alias("n")), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.greatest(l2_norm(a), F.lit(1e-12)) * F.greatest(l2_norm(b), F.lit(1e-12)))


def project(v, mean: list[float], components: list[list[float]]) -> Column:
    """Centred on the mean, onto the components, to unit length: one dense product for each Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(vectors):
        import numpy as np

        known = [list(x) for x in vectors if x is not None]
        if not known:
            return vectors
        x = (np.array(known, float) - np.array(mean)) @ np.array(components).T
        rows = iter(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
        return vectors.__class__([None if v is None else next(rows) for v in vectors])

    return run(_c(v))


def hash_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def hash_bucket(token, seed: int = 0, dim: int = 256) -> Column:
    """The first four md5 bytes of ``seed:token`` as a little-endian number, modulo ``dim``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), token).cast("binary"))
    swapped = F.concat(*(F.substring(digest, k, 2) for k in (7, 5, 3, 1)))
    return F.pmod(F.conv(swapped, 16, 10).cast("long"), F.lit(dim)).cast("int")


def hashing_vector(text, seed: int = 0, dim: int = 256) -> Column:
    """Counts of :func:`hash_tokens` by :func:`hash_bucket`, as a dense array of doubles: each token is hashed once."""

    @F.pandas_udf("array<double>")
    def run(texts):
        import hashlib
        import re

        import numpy as np

        words, known = re.compile("[a-z0-9]+"), {}

        def bucket(token: str) -> int:
            if token not in known:
                if len(known) >= 200_000:
                    known.clear()
                known[token] = int.from_bytes(hashlib.md5(f"{seed}:{token}".encode()).digest()[:4], "little") % dim
            return known[token]

        return texts.map(lambda t: None if t is None else np.bincount([bucket(w) for w in words.findall(t.lower())], minlength=dim).astype(float))

    return run(_c(text))


def unit_hash(*parts) -> Column:
    """A number in [0, 1] from the first eight md5 bytes (little-endian) of the parts, joined by unit separators."""
    digest = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    high = F.conv(F.concat(*(F.substring(digest, k, 2) for k in (15, 13, 11, 9))), 16, 10).cast("double")
    low = F.conv(F.concat(*(F.substring(digest, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("double")
    return (high * 4294967296.0 + low) / 18446744073709551616.0


def draw_order(place, query, seed: int, bits: int, rounds: int = 4) -> Column:
    """The place-th number of a random order of 0 .. 4**bits - 1 that seed and query decide: a Feistel network over two halves of ``bits`` bits, mixed by md5."""
    mask = F.lit((1 << bits) - 1)
    left, right = F.shiftright(_c(place), bits), _c(place).bitwiseAND(mask)
    for r in range(rounds):
        mixed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), _c(query).cast("string"), F.lit(str(r)), right.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
        left, right = right, left.bitwiseXOR(mixed).bitwiseAND(mask)
    return F.shiftleft(left, bits).bitwiseOR(right)


def mock_verdict(question, step, n_references, seed: int = 17) -> Column:
    """struct(math_ok, consistency_ok, correctness_prob) of the deterministic scorer: no model, only its contract."""
    # fixed values: how far references move a score, and the bounds below which a step is flagged
    nudge, math_bound, consistency_bound = 0.35, 0.12, 0.22
    salt = F.lit(str(seed))
    base = unit_hash(salt, _c(question), _c(step))
    moved = base + nudge * _c(n_references) * (unit_hash(salt, F.lit("ref"), _c(question), _c(step)) - 0.5)
    score = F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))
    return F.struct((score >= math_bound).alias("math_ok"), ((score < math_bound) | (score >= consistency_bound)).alias("consistency_ok"), F.when(score >= consistency_bound, score).alias("correctness_prob"))
