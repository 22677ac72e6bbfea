"""Reading tables, and the shared folder in which results that are used twice are kept."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text that a Python worker takes from Arrow at a time, if it isn't a single row's.
AT_ONCE = 8 << 20
#: Spark's setting by which the shuffle files of a query are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = AT_ONCE, holding: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose strings of that column have at most that many bytes, or one row; empty ones stay.
    What the worker holds of earlier jobs goes, unless this one says that it holds something itself."""
    if not holding:
        released()
    try:
        for batch in batches:
            strings, begin = batch.column(column), 0
            kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
            ends = np.frombuffer(strings.buffers()[1], kind)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, kind)
            while True:
                end = max(begin + 1, int(np.searchsorted(ends, int(ends[begin]) + most, "right")) - 1)
                yield batch.slice(begin, end - begin)
                if (begin := end) >= len(batch):
                    break
            del batch, strings, ends
    finally:
        trimmed()  # the worker may stay idle beside those of the next job


_HELD: dict = {}


def released() -> None:
    """Gives back the memory of what is held, and what earlier jobs left free in the worker."""
    _HELD.clear()
    gc.collect()
    trimmed()


def trimmed() -> None:
    """Returns free memory of Arrow's pool and of the C library to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def held(of: tuple, key, make: Callable):
    """make(), remembered by the Python worker as long as it is asked for things of the same kind: those of others, models and
    vocabularies of earlier jobs, go before anything new is made."""
    if _HELD.get("of") != of:
        released()
        _HELD["of"] = of
    if key not in _HELD:
        _HELD[key] = make()
        trimmed()  # what making it took
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the session names none (tests), one of this machine's."""
    sc = spark.sparkContext
    if not (at := spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="netquarry-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/netquarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors. Shuffle files of the
    write go when it has ended, not when the driver next collects its garbage."""
    return kept(df, name)[0]


def saved(df: DataFrame, path: str, *by: str) -> None:
    """Writes df to the folder, in one of its own for each value of by; then the shuffle files of the write go."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """As written(), and a function that deletes the folder once nothing reads it any more."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    saved(df, path)
    return spark.read.schema(df.schema).parquet(path), lambda: removed(spark, path)


def settled(spark: SparkSession) -> None:
    """The driver collects its garbage, since only then Spark lets go of the broadcasts and shuffles of jobs that have ended, and
    returns free memory of the C library to the machine, where its Java has the command for it."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    named = jvm.java.lang.Class.forName
    types, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, of in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = named(of)
    try:
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is closed to callers
        named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # a Java without the command
        pass


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but own under names that clash with nothing, and a function that gives a result its
    columns back, in their order."""
    names = {c: c if c in own else f"_column_{i}_" for i, c in enumerate(docs.columns)}
    shown = docs.toDF(*names.values())
    return shown, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])
