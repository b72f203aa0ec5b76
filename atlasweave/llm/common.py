"""What the operators share: the folder that all executors see, and tables written there."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a single-machine session may lack the setting (as in tests); it gets a folder of its own that goes at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # noqa: SLF001  for release()
    return out


def release(df: DataFrame) -> None:
    """Deletes a table that materialise() wrote and that no later step reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df (case aside) has: helper columns never meet a document's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of an Arrow batch, where the session doesn't say. Ten thousand documents, the usual limit, can be any size.
BATCH_BYTES = 4 << 20
#: What modules keep in a worker between tasks, by owner: functions that drop it.
CACHES: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Returns memory that is free to the system: a worker waits, idle, while other operators need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, owner: str = "") -> DataFrame:
    """df.mapInArrow over batches of bounded size. A task first drops what other owners keep in its worker, and gives memory back at its end."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, drop in CACHES.items():
            if name != owner:
                drop()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)
