"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.shipping import ship

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_made: list[tuple[SparkSession, str]] = []


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, _UPPER, _UPPER.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: lambdas are interpreted, and repeat what they repeat."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that the cluster names, else (tests) one of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
        _made.append((spark, base))
    return base.rstrip("/")


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, with the writer's ``options``, and read it back.

    The result has no lineage to its inputs, so a lost executor costs nothing
    but the reading of files; unlike ``checkpoint()`` it is computed once.
    Tables are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _made.append((spark, path))
    release_jvm(spark)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the table behind a frame that ``stage`` returned, once nothing needs it."""
    for file in df.inputFiles()[:1]:
        path = file.rsplit("/", 1)[0]
        if "/lattica-" in path:
            _delete(df.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand texts to Python in batches of at most ``rows``.  Spark's 10,000 whole texts would be held several times over: in the JVM, in transit and in the worker."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release_jvm(spark: SparkSession) -> None:
    """The driver's JVM collects garbage, and what its threads have freed outside the heap goes back to the system.

    Compiling and planning leave hundreds of megabytes in the allocator's arenas,
    which no collection shrinks.  A JVM without that command keeps them.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    (invoke,) = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return


def release(spark: SparkSession, executors: bool = False) -> None:
    """Let Spark drop shuffle files and broadcasts of frames that nothing refers to any more: it does so as the driver collects garbage.

    The driver's Python gives free memory back as well.
    With ``executors`` they collect theirs too, and heaps that one stage has
    grown shrink before the next one's Python workers start; idle workers give
    back what earlier stages have freed in them.
    """
    _give_back()
    release_jvm(spark)
    if executors:
        ship(spark)
        n = 2 * spark.sparkContext.defaultParallelism
        tasks = spark.range(0, n, 1, n)
        tasks.select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()
        tasks.mapInArrow(_give_back_between, "id long").write.format("noop").mode("overwrite").save()


def _give_back() -> None:
    """This Python's garbage and free memory go back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; else the allocator keeps what it has
    if trim:
        trim(0)


def _give_back_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    _give_back()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; nothing is left to do then
            return


def n_buckets(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Enough buckets for ``rows`` at ``rows_each``, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each), 1)
