"""Intermediate tables: written once below the folder that driver and executors share, and read back.

A written table cuts the lineage. A lost executor then costs the tasks that it ran, never what stands before the table.
A session's tables lie below ``parcelyze/<application id>`` there. They go when the driver's Python process ends, as
DataFrames that a query has returned may still read them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()

#: Up to so many bytes, by Spark's estimate, a table is broadcast without being told to. The driver builds a broadcast whole, and an
#: estimate by files and column widths may be far below what that takes; tables that are surely small are marked.
BROADCAST_BYTES = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where the session names none: a local folder if all runs in one
    process, an error on a cluster, whose executors would not see each other's files."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="parcelyze-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def _delete(jvm, hadoop, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(hadoop).delete(p, True)


def _delete_quietly(jvm, hadoop, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone before the process ends
        _delete(jvm, hadoop, path)


def session_dir(spark: SparkSession) -> str:
    """The folder of this session's tables."""
    path = f"{shared_dir(spark)}/parcelyze/{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_delete_quietly, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _trim(jvm) -> None:
    """Has the driver's C library give back what the JVM's threads have freed. It keeps that thread by thread (compilers' most of
    all), beside the heap. By the interface of the management server, whose own class is closed to callers."""
    lang, array = jvm.java.lang, SparkContext._gateway.new_array
    kinds = [jvm.javax.management.ObjectName._java_lang_class, lang.String._java_lang_class]
    kinds += [lang.Class.forName("[Ljava.lang.Object;"), lang.Class.forName("[Ljava.lang.String;")]
    given = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(lang.Object, 0), array(lang.String, 0)]
    types, values = array(lang.Class, 4), array(lang.Object, 4)
    for k in range(4):
        types[k], values[k] = kinds[k], given[k]
    call = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
    call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def _tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage once that fills half of what its heap may take, and give the room back: old plans,
    generated classes, and whatever keeps shuffle files of tables that are written. Little of it is live between two tables."""
    room = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * room.totalMemory() > room.maxMemory():
        spark._jvm.java.lang.System.gc()
    with contextlib.suppress(Exception):  # not each JVM and C library can
        _trim(spark._jvm)


@contextlib.contextmanager
def _tidied(spark: SparkSession, every_s: float = 10.0) -> Iterator[None]:
    """Tidies the driver after a table, and again and again while a large one is written: its tasks' events fill the heap meanwhile."""
    over = threading.Event()

    def run() -> None:
        while not over.wait(every_s):
            with contextlib.suppress(Exception):  # the session may end meanwhile
                _tidy(spark)

    threading.Thread(target=run, daemon=True).start()
    try:
        yield
    finally:
        over.set()
    _tidy(spark)


@contextlib.contextmanager
def _few_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Holds the session's limits of unmarked broadcasts at ``BROADCAST_BYTES``, where they are higher."""
    had = {}
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        text = spark.conf.get(key, None)
        if text and not text.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text) > BROADCAST_BYTES:
            had[key] = text
            spark.conf.set(key, str(BROADCAST_BYTES))
    try:
        yield
    finally:
        for key, text in had.items():
            spark.conf.set(key, text)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table below the shared folder, with the same schema; codec: the session's, or another. Unmarked broadcasts are few."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _tidied(df.sparkSession), _few_broadcasts(df.sparkSession):
        df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration(), t.written_path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... over the whole table in an order, without bringing it to one task.

    Rows are dealt by ranges of the order; a range's first number comes from the counts of the ranges before it.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(counts), "_range").withColumn(name, F.col("_ahead") + F.col("_place") - 1).drop("_range", "_place", "_ahead")
