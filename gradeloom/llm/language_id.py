"""Operator 2: language identification by nearest centroids.

A text's letters (in lower case, everything else between them one blank) give counts of 1-, 2- and
3-grams in a fixed number of hashed dimensions; the vector is the root of the counts, weighted by inverse
document frequency and normalised. Each language has several centroids, clustered from its documents by
cosine; the nearest centroid's language is predicted.

Document frequencies come from all documents that may be learned from. The clustering uses a bounded
sample of them: at most ``sample`` documents of each language in expectation (by a hash of the id), and
at most ``most`` in all, whatever the corpus. Each language is clustered in a task of its own.

Distance-based rejection: all documents that may be learned from are measured against the centroids of
their own language. A document is rejected if its nearest centroid is further than all but the share
``OUTLIERS`` of that language's documents of the same class of length lie (short texts lie further away); a
class of fewer than ``LEAST_DOCS`` documents takes the bound of the next shorter one. Similarities below
``FLOOR`` are always rejected. So is a document of strange n-grams: the share of its vector's squared
length that lies in n-grams known to its language (those of two or more clustered documents, so that none
vouches for itself) must reach what all but the share ``STRANGE`` of that language's documents reach, at any
length; languages of fewer than ``LEAST_DOCS`` documents have no such bound. Other languages of the same script lie about as near as the shortest texts do, but are strange. Rejected documents keep their predicted language; ``und`` is only given
to texts without a letter, which are rejected too.

Defined cases: null and empty texts are ``und`` with score 0; documents with a null language are not
learned from; if nothing can be learned every document is ``und``; rows that repeat are predicted each
for itself; other columns are not read; kept columns with the name of a result are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_id, held, refuse_clashes, sliced, spread, table

DIMENSIONS = 8192
CLUSTERS = 4
SAMPLE = 500
MOST = 20_000
#: share of a language's documents that lie too far from its centroids
OUTLIERS = 0.003
#: share of a language's documents whose n-grams are too little known
STRANGE = 0.001
LEAST_DOCS = 300
FLOOR = 0.03
_BINS = 500
#: lower bounds of classes of lengths (in n-grams) that have thresholds of their own
LENGTHS = (0, 20, 60, 180, 540, 1620)
SHARPNESS = 12.0


class Grams:
    """Hashed counts of letter n-grams."""

    def __init__(self, dimensions: int = DIMENSIONS):
        import numpy as np

        self.np, self.dimensions = np, dimensions
        self.letter = np.array([chr(c).isalpha() for c in range(0x110000)])

    def counts(self, text: str):
        """Counts by dimension; None if the text has no letter."""
        np = self.np
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[points]
        if not letter.any():
            return None
        points = np.where(letter, points, 32)
        keep = np.ones(len(points), bool)
        keep[1:] = letter[1:] | letter[:-1]  # of blanks in a row the first
        points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
        mul = np.uint64(0x9E3779B97F4A7C15)
        one = (points + np.uint64(1)) * mul
        two = (one[:-1] ^ (one[1:] >> np.uint64(17))) * mul
        three = (two[:-1] ^ (one[2:] >> np.uint64(23))) * mul
        grams = np.concatenate((one[1:-1], two, three))
        return np.bincount((grams >> np.uint64(40)).astype(np.int64) % self.dimensions, minlength=self.dimensions)


def _weigh(counts, idf):
    import numpy as np

    v = np.sqrt(counts) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def _length_class(n) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def _statistics(learnable: DataFrame, dimensions: int):
    """(documents by language, document frequency of each dimension) over all learnable documents."""
    import numpy as np

    def run(it):
        import pyarrow as pa

        grams, df, langs = held(Grams, dimensions), np.zeros(dimensions, np.int64), {}
        for b in sliced(it):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                c = grams.counts(text or "")
                if c is not None:
                    df += c > 0
                    langs[lang] = langs.get(lang, 0) + 1
        some = np.flatnonzero(df)
        names, counts = [*langs], [*langs.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*names, *[None] * len(some)], pa.string()), pa.array([*[None] * len(names), *some.tolist()], pa.int32()), pa.array([*counts, *df[some].tolist()], pa.int64())], names=["lang", "dimension", "n"])

    found = learnable.mapInArrow(run, "lang string, dimension int, n long").groupBy("lang", "dimension").agg(F.sum("n")).collect()  # a row for each language and dimension
    df = np.zeros(dimensions, np.int64)
    for lang, dimension, n in found:
        if lang is None:
            df[dimension] = n
    return {lang: n for lang, _, n in found if lang is not None}, df


def cluster(vectors, k: int, rounds: int = 12, seed: int = 7):
    """Unit centroids of unit vectors by cosine (spherical k-means, first centroids far from each other)."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    centroids = [vectors.mean(axis=0)]
    centroids[0] = centroids[0] / max(np.linalg.norm(centroids[0]), 1e-12)
    near = vectors @ centroids[0]
    for _ in range(min(k, len(vectors)) - 1):
        far = np.clip(1 - near, 0, None) ** 2
        pick = vectors[rng.choice(len(vectors), p=far / far.sum())] if far.sum() > 0 else vectors[0]
        centroids.append(pick)
        near = np.maximum(near, vectors @ pick)
    c = np.stack(centroids)
    for _ in range(rounds):
        own = (vectors @ c.T).argmax(axis=1)
        new = np.stack([vectors[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c.astype(np.float32)


class Centroids:
    """The model: centroids of all languages, n-grams known to each, and bounds of similarity and of known shares."""

    def __init__(self, idf, langs, owners, centroids, nearest, known=None, least_known=None):
        self.idf, self.langs, self.owners, self.centroids, self.nearest, self.known, self.least_known = idf, langs, owners, centroids, nearest, known, least_known

    def known_share(self, k: int, vector) -> float:
        """How much of a unit vector's squared length lies in n-grams known to language ``k``."""
        return min(1.0, float(vector @ (vector * self.known[k])))

    def predict(self, counts):
        """(language, score, similarity, share of known n-grams, rejected) of one document's counts."""
        import numpy as np

        if counts is None or not len(self.langs):
            return "und", 0.0, 0.0, 0.0, True
        vector = _weigh(counts, self.idf)
        near = self.centroids @ vector
        best = np.full(len(self.langs), -1.0, np.float32)
        np.maximum.at(best, self.owners, near)
        k = int(best.argmax())
        e = np.exp(SHARPNESS * (best - best[k]))
        share = self.known_share(k, vector)
        rejected = best[k] < self.nearest[k][_length_class(counts.sum())] or share < self.least_known[k]
        return self.langs[k], float(min(1.0, 1 / e.sum())), float(min(1.0, max(0.0, best[k]))), share, bool(rejected)


#: stands in place of a class of length for shares of known n-grams
_KNOWN = -1


def _similarities(learnable: DataFrame, model: Centroids, dimensions: int) -> list[tuple[str, int, int, int]]:
    """(language, class of length, bin of similarity to the own language's centroids, documents) over all of ``learnable``; under ``_KNOWN`` bins of the shares of known n-grams."""
    import numpy as np

    tables = learnable.sparkSession.sparkContext.broadcast(model)

    def run(it):
        import pyarrow as pa

        grams, m, seen = held(Grams, dimensions), tables.value, {}
        of = {lang: (k, m.centroids[m.owners == k]) for k, lang in enumerate(m.langs)}
        for b in sliced(it):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if lang in of and (c := grams.counts(text or "")) is not None:
                    (k, own), vector = of[lang], _weigh(c, m.idf)
                    for length, x in ((_length_class(c.sum()), float((own @ vector).max())), (_KNOWN, m.known_share(k, vector))):
                        key = lang, length, int(min(_BINS - 1, max(0, x * _BINS)))
                        seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in seen], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32()))), pa.array([*seen.values()], pa.int64())], names=["lang", "length", "bin", "n"])

    found = learnable.mapInArrow(run, "lang string, length int, bin int, n long").groupBy("lang", "length", "bin").agg(F.sum("n")).collect()  # at most languages x lengths x bins rows
    return [tuple(r) for r in found]


def least_share(counts: list[tuple[int, int, int]], strange: float, least_docs: int = LEAST_DOCS) -> float:
    """The least share of known n-grams that is not rejected, from rows as :func:`bounds` takes them; 0 with too few documents to tell."""
    own = sorted((b, n) for length, b, n in counts if length == _KNOWN)
    total, at = sum(n for _, n in own), 0
    for b, n in own if total >= least_docs else ():
        at += n
        if at > strange * total:
            return b / _BINS
    return 0.0


def bounds(counts: list[tuple[int, int, int]], outliers: float, least_docs: int) -> list[float]:
    """The least similarity that is not rejected in each class of lengths, from (class, bin, documents)."""
    out, low = [], FLOOR
    for k in range(len(LENGTHS)):
        own = sorted((b, n) for length, b, n in counts if length == k)
        if (total := sum(n for _, n in own)) >= least_docs:
            at = 0
            for b, n in own:
                at += n
                if at > outliers * total:
                    low = max(FLOOR, b / _BINS)
                    break
        out.append(low)
    return out


def learn(learnable: DataFrame, sample: int = SAMPLE, most: int = MOST, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS, outliers: float = OUTLIERS, strange: float = STRANGE, least_docs: int = LEAST_DOCS) -> Centroids:
    """Centroids of ``learnable(doc_id, text, lang)``."""
    import numpy as np

    learnable = spread(learnable)
    sizes, df = _statistics(learnable, dimensions)
    langs = sorted(sizes)
    if not langs:
        return Centroids(None, [], None, None, None)
    idf = np.log((1 + sum(sizes.values())) / (1 + df)).astype(np.float32) + 1
    bound = min(sample, max(1, most // len(langs)))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, bound / sizes[lang]))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)

    def run(it):
        import pyarrow as pa

        grams = held(Grams, dimensions)
        for b in sliced(it):
            rows = [(i, lang, np.flatnonzero(c), c) for i, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if (c := grams.counts(text or "")) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([at.astype(np.uint32).tobytes() for *_, at, _ in rows], pa.binary()), pa.array([c[at].astype(np.uint32).tobytes() for *_, at, c in rows], pa.binary())], names=["doc_id", "lang", "at", "n"])

    def clustered(key, rows):
        import pyarrow as pa

        rows = rows.sort_by([("doc_id", "ascending"), ("at", "ascending"), ("n", "ascending")])
        vectors = np.zeros((rows.num_rows, dimensions), np.float32)
        for v, at, n in zip(vectors, rows.column("at").to_pylist(), rows.column("n").to_pylist(), strict=True):
            v[np.frombuffer(at, np.uint32)] = np.frombuffer(n, np.uint32)
        shared = np.packbits((vectors > 0).sum(axis=0) > 1).tobytes()
        vectors = np.sqrt(vectors) * idf
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        own = cluster(vectors, clusters)
        return pa.table([pa.array([key[0].as_py()] * len(own), pa.string()), pa.array([c.tobytes() for c in own], pa.binary()), pa.array([shared] * len(own), pa.binary())], names=["lang", "centroid", "known"])

    rows = learnable.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(drawn).mapInArrow(run, "doc_id long, lang string, at binary, n binary")
    # clusters rows for each language, of dimensions numbers
    found = sorted((r["lang"], bytes(r["centroid"]), bytes(r["known"])) for r in rows.groupBy("lang").applyInArrow(clustered, "lang string, centroid binary, known binary").collect())
    langs = sorted({lang for lang, *_ in found})
    if not langs:
        return Centroids(None, [], None, None, None)
    known = {lang: np.unpackbits(np.frombuffer(own, np.uint8), count=dimensions).astype(np.float32) for lang, _, own in found}
    model = Centroids(idf, langs, np.array([langs.index(lang) for lang, *_ in found]), np.stack([np.frombuffer(c, np.float32) for _, c, _ in found]), None, np.stack([known[lang] for lang in langs]))
    seen = _similarities(learnable, model, dimensions)
    model.nearest = [bounds([r[1:] for r in seen if r[0] == lang], outliers, least_docs) for lang in langs]
    model.least_known = [least_share([r[1:] for r in seen if r[0] == lang], strange, least_docs) for lang in langs]
    return model


def identify(docs: DataFrame, model: Centroids, keep: list[str], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """The kept columns of ``docs`` and lang_pred, score, similarity, known_share, rejected; one pass without a shuffle."""
    refuse_clashes(keep, ("lang_pred", "score", "similarity", "known_share", "rejected"))
    tables = docs.sparkSession.sparkContext.broadcast(model)  # (languages x clusters + 1) x dimensions numbers
    own = docs.select(*dict.fromkeys([*keep, text]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keep).schema.fields)

    def run(it):
        import pyarrow as pa

        grams = held(Grams, dimensions)
        for b in sliced(it):
            found = [tables.value.predict(grams.counts(t or "")) for t in b.column(text).to_pylist()]
            cols = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()), strict=True))], names=[*keep, "lang_pred", "score", "similarity", "known_share", "rejected"])

    return own.mapInArrow(run, f"{schema}, lang_pred string, score double, similarity double, known_share double, rejected boolean")


def learnable(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    return docs.where((fold_id("doc_id", folds) != held_out) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    found = identify(docs, learn(learnable(docs)), ["doc_id"])
    return found.select("doc_id", (fold_id("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "similarity", "known_share", "rejected")
