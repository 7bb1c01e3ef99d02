"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark's readers have to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small table often lies in one, and Python takes long over each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset (as in local tests) a folder under /tmp is set; that is only
    allowed in local mode, since executors elsewhere would not see it.
    """
    found = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_DIR} must name a folder that all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set(_DIR, found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    The folder is deleted when the driver ends, since results that a caller still holds read from it.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.base}/{len(self.paths)}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.path(name)
        self.paths.append(path)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads; shuffle files of plans that are gone go with them."""
        self.discard(*frames)
        self.release()

    def discard(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let go of the shuffle files of plans that are gone."""
        gc.collect()
        self.spark._jvm.System.gc()  # else the cleaner waits until the driver's heap fills up


def tokenizer_path(name: str, path: str | None = None) -> str:
    """Where a public tokenizer's vocabulary lies: ``path`` if given, else the installed file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def fold_id(doc_id, mod: int):
    """crc32 of the id's text modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def crc_fold(doc_id, mod: int) -> int:
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def refuse_clashes(keep, results) -> None:
    """Kept columns must not have the name of a result: neither could be told from the other."""
    if both := [c for c in keep if c.lower() in {r.lower() for r in results}]:
        raise ValueError(f"rename the columns {both} first: the results have these names")


class Cache(dict):
    """A dict that fills itself by ``make``; beyond ``most`` entries or ``size`` key units only those used since it was last full stay."""

    def __init__(self, make, most: int = 400_000, size: int = 40_000_000):
        super().__init__()
        self.make, self.most, self.size, self.used, self.old = make, most, size, 0, {}

    def __missing__(self, key):
        if len(self) >= self.most or self.used > self.size:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self.used += len(key)
        out = self.old.get(key)
        out = self[key] = self.make(key) if out is None else out
        return out


_HELD: dict = {}


def held(make, *args):
    """``make(*args)``, made once in each Python worker: later tasks of the same operator find its caches filled.

    A worker holds one such object, so that the caches of earlier operators don't add up.
    """
    if (make, args) not in _HELD:
        _HELD.clear()
        _HELD[make, args] = make(*args)
    return _HELD[make, args]


def sliced(batches, rows: int = 1000):
    """Arrow batches in slices of so many rows, which bounds what a task makes Python objects of at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def quiet_workers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
