"""What the operators of this subpackage share: the scratch folder, staged tables, hashing and the label fold."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One Arrow batch holds at most so many rows, so that a run of very long texts stays small in a Python worker.
BATCH_ROWS = 512
#: Files that a table staged `together` has for each core at most.
FILES_A_CORE = 4


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers get (rows here; Spark's own limit bounds their bytes)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where that is unset and
    all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spindrel-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if "://" in found else f"file://{found.rstrip('/')}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder; it isn't created."""
    return f"{shared_dir(spark)}/spindrel/{name}-{uuid.uuid4().hex[:12]}"


_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def staged(df: DataFrame, name: str, together: bool = False) -> DataFrame:
    """df, written once to the shared folder as Parquet and read again: cuts lineage, survives lost executors.

    Hadoop's local file system starts processes for each file (chmod), and until such a child runs its own program, it counts
    with all memory of its executor. So where many partitions may hold little, `together` has a task write several.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    (df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism) if together else df).write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _folders[found] = path
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of staged tables that nothing will read again."""
    for df in frames:
        if path := _folders.pop(df, None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


_remembered: list[dict] = []


def only(memory: dict | None = None) -> dict | None:
    """memory, in which this worker remembers words for one operator; what it remembered for others is forgotten.

    Spark reuses workers, so each would come to hold the words of every operator that has run in the session.
    """
    if not (_remembered and _remembered[0] is memory):
        for m in _remembered:
            m.clear()
        _remembered[:] = [] if memory is None else [memory]
    return memory


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any file system that pyarrow has a driver for, not only local paths."""
    return pafs.FileSystem.from_uri(uri)


def columns_of(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def fold(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 5; labels are learnt only where it isn't 0. A null id has no fold."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def share(key: Column, keep: int, total: int) -> Column:
    """True for about keep of total rows, the same ones in every run; for all rows where total isn't larger."""
    return F.lit(True) if total <= keep else F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * keep / total)


def with_scores(docs: DataFrame, scores: Callable[[list[str | None]], list[float] | np.ndarray]) -> DataFrame:
    """docs with `score`, made of the column `text`. Other columns stay, whatever their names; an own column `score` is replaced."""
    docs = docs.drop("score")
    names, plain = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    text = plain[names.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in batches:
            got = pa.array(scores(b.column(text).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*plain, "score"])

    renamed = docs.toDF(*plain)
    kind = T.StructType([*renamed.schema.fields, T.StructField("score", T.DoubleType())])
    return renamed.mapInArrow(run, kind).toDF(*names, "score")


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam over a list of numpy arrays, changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
