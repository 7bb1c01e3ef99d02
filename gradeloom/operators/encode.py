"""Encoders and the projection onto principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hashing_vector, l2_normalise, project

_ENCODERS: dict[str, Callable[[Column], Column]] = {}


def register_encoder(name: str, encode: Callable[[Column], Column]) -> None:
    """Make an encoder known: from a text column to an array of numbers (a native expression or a pandas UDF)."""
    _ENCODERS[name] = encode


def batch_encoder(encode: Callable[[list[str]], Iterable[Iterable[float]]]) -> Callable[[Column], Column]:
    """An encoder for :func:`register_encoder` from a function over lists of texts, run on Arrow batches."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encode(texts.fillna("").tolist())])

    return run


def mean_pooled(embed: Callable[[list[str]], tuple], unit: bool = True) -> Callable[[list[str]], Iterable[Iterable[float]]]:
    """For :func:`batch_encoder`, from a model's vectors of tokens: ``embed`` gives (texts x places x width) and a mask of real tokens.

    A text's vector is the mean over its real tokens, to unit length unless ``unit`` is off (a projection is fitted
    on vectors of one length, and others would lie far off it); one without any is the zero vector.
    """

    def run(texts: list[str]):
        import numpy as np

        states, mask = (np.asarray(x, float) for x in embed(texts))
        mean = (states * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12) if unit else mean

    return run


def build_encoder(name: str) -> Callable[[Column], Column]:
    """A registered encoder. An unknown name is an error: another encoder in its place would change every result."""
    if name == "hashing":
        return hashing_vector
    if name not in _ENCODERS:
        raise ValueError(f"no encoder is registered as {name!r}; known: {sorted(['hashing', *_ENCODERS])}")
    return _ENCODERS[name]


def encode(df: DataFrame, text: str, name: str = "hashing", out: str = "vec") -> DataFrame:
    return df.withColumn(out, build_encoder(name)(F.col(text)))


def fit_projection(vectors: DataFrame, k: int, vec: str = "vec", whiten: bool = False) -> dict | None:
    """mean and components (k rows) of the principal axes, signs fixed so that the largest entry is positive.

    Sums and cross products are added up on the executors; what reaches the driver is one d x d matrix.
    None if fewer than two components can be had.
    """
    import numpy as np

    def run(batches):
        import pandas as pd

        n, total, cross = 0, None, None
        for pdf in batches:
            if not pdf.empty:
                x = np.array([list(v) for v in pdf[vec]], dtype=float)
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                cross = x.T @ x if cross is None else cross + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tolist()], "cross": [cross.ravel().tolist()]})

    parts = vectors.select(vec).mapInPandas(run, "n long, total array<double>, cross array<double>").toLocalIterator()
    n, total, cross = 0, None, None
    for p in parts:  # one row for each task
        n += p["n"]
        t, c = np.array(p["total"]), np.array(p["cross"])
        total, cross = (t, c) if total is None else (total + t, cross + c)
    if not n:
        return None
    d = len(total)
    mean = total / n
    scatter = cross.reshape(d, d) - n * np.outer(mean, mean)
    values, axes = np.linalg.eigh(scatter)
    keep = np.argsort(-values)[: min(k, n, d)]
    if len(keep) < 2:
        return None
    return _model(mean, axes[:, keep].T, values[keep], values.sum(), n, whiten)


def _model(mean, axes, values, total: float, n: int, whiten: bool) -> dict:
    """Axes (as rows) with their largest entry positive, scaled to unit variance if whitened, and their shares of the variance."""
    import numpy as np

    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    if whiten:
        axes = axes / np.maximum(np.sqrt(np.maximum(values, 0) / max(n - 1, 1)), 1e-12)[:, None]
    return {"mean": mean.tolist(), "components": axes.tolist(), "explained": (values / max(total, 1e-12)).tolist()}


#: rows of a d x width product that are added up together on an executor
_SLICE = 256


def fit_projection_wide(vectors: DataFrame, k: int, vec: str = "vec", whiten: bool = False, extra: int = 16, rounds: int = 100, tolerance: float = 1e-9, seed: int = 0) -> dict | None:
    """As :func:`fit_projection`, for vectors too wide for a d x d matrix in a task: randomised subspace iteration.

    Each round is one pass: a task multiplies its centred vectors with a basis of ``k + extra`` directions and back
    again, d x (k + extra) numbers, which are added up on the executors in slices; the driver makes a new basis of
    the sum. It ends once the axes' residuals (|S v - value v| over the largest value) are below ``tolerance``, or
    after ``rounds`` passes; ``residual`` tells how exact the axes are, which close values make slow.
    """
    import numpy as np

    def first(batches):
        import pandas as pd

        n, total = 0, None
        for pdf in batches:
            if not pdf.empty:
                x = np.array([list(v) for v in pdf[vec]], dtype=float)
                n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tolist()]})

    def added(key, rows):
        import pyarrow as pa

        out = sum(np.frombuffer(b) for b in rows.column("y").to_pylist())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary()), pa.array([sum(rows.column("squares").to_pylist())], pa.float64())], names=["slice", "y", "squares"])

    n, total = 0, None
    for r in vectors.select(vec).mapInPandas(first, "n long, total array<double>").toLocalIterator():  # one row for each task
        n, total = n + r["n"], np.array(r["total"]) if total is None else total + np.array(r["total"])
    if not n:
        return None
    d = len(total)
    mean, keep = total / n, min(k, n, d)
    if keep < 2:
        return None
    width = min(keep + extra, d)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]

    def product(basis):
        """S times the basis, and the trace of S, for S the scatter matrix."""

        def run(batches):
            import pandas as pd

            y, squares = np.zeros((d, width)), 0.0
            for pdf in batches:
                if not pdf.empty:
                    x = np.array([list(v) for v in pdf[vec]], dtype=float) - mean
                    y += x.T @ (x @ basis)
                    squares += float((x * x).sum())
            at = range(0, d, _SLICE)
            yield pd.DataFrame({"slice": [i // _SLICE for i in at], "y": [y[i : i + _SLICE].tobytes() for i in at], "squares": [squares if i == 0 else 0.0 for i in at]})

        parts = vectors.select(vec).mapInPandas(run, "slice int, y binary, squares double").groupBy("slice").applyInArrow(added, "slice int, y binary, squares double")
        rows = sorted(parts.collect(), key=lambda r: r["slice"])  # d x width numbers
        return np.concatenate([np.frombuffer(r["y"]).reshape(-1, width) for r in rows]), sum(r["squares"] for r in rows)

    for _ in range(rounds):
        y, trace = product(basis)
        values, turn = np.linalg.eigh((basis.T @ y + y.T @ basis) / 2)
        top = np.argsort(-values)[:keep]
        axes, values = (basis @ turn)[:, top], values[top]
        residual = float(np.linalg.norm(y @ turn[:, top] - axes * values, axis=0).max() / max(values[0], 1e-300))
        if residual <= tolerance:
            break
        basis = np.linalg.qr(y)[0]
    return _model(mean, axes.T, values, trace, n, whiten) | {"residual": residual}


def apply_projection(df: DataFrame, model: dict | None, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Unit vectors, projected if there is a model."""
    return df.withColumn(out, l2_normalise(vec) if model is None else project(vec, model["mean"], model["components"]))


def unique_questions(pool: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row for each qid, with the question text that stands first."""
    return pool.groupBy("qid").agg(F.min_by("question", order).alias("question"))


def build_index(pool: DataFrame, encoder: str = "hashing", k: int = 128, whiten: bool = False, fit: Callable = fit_projection) -> tuple[DataFrame, DataFrame, dict]:
    """(question vectors, step vectors, model): one projection for both, each unique question encoded once.

    ``fit`` is :func:`fit_projection`, or :func:`fit_projection_wide` for encoders of many dimensions.
    """
    questions = encode(unique_questions(pool), "question", encoder)
    steps = encode(pool.select("item_id", "qid", "step"), "step", encoder)
    both = questions.select("vec").union(steps.select("vec"))
    model = fit(both, k, whiten=whiten)
    meta = {"encoder": encoder, "dim": k if model is None else len(model["components"]), "projection": model}
    return apply_projection(questions, model), apply_projection(steps, model), meta
