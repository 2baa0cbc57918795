"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
#: edges in a file of a step of ``components``
FILE_EDGES = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the cluster names none and the master is this machine (tests) an own folder is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="vertexloom-shared-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read and not a recomputation.  No ``_SUCCESS`` file: on a
    local file system the driver starts a process for every file that it makes.  What the driver's JVM holds
    free after the job goes back to the system."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    give_back_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's stored tables, once results that read them have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a table of a checked size; otherwise leave a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df


def shielded(docs: DataFrame, taken) -> tuple[DataFrame, list]:
    """``docs`` with its columns named in ``taken`` under private names, and the columns that restore it."""
    taken = {t.lower() for t in taken}
    private = {c: f"__own_{c}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(private), [F.col(f"`{private.get(c, c)}`").alias(c) for c in docs.columns]


@functools.lru_cache(1)
def _libc():
    import ctypes

    libc = ctypes.CDLL(None)
    return getattr(libc, "malloc_trim", None)


def give_back() -> None:
    """Return free memory of a Python worker to the system: workers are kept between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _libc():
        _libc()(0)


def give_back_driver(spark: SparkSession) -> bool:
    """Return free native memory of the driver's JVM to the system, as its allocator keeps what planning,
    compilers and buffers have freed; False where the JVM has no such command (before 17.0.9, or no glibc)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:
        of = jvm.java.lang.Class.forName
        kinds = map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = of("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", None, None))
    except (Py4JError, PySparkException):
        return False
    return True


def text_slices(batch, column: str, chars: int):
    """Cut an Arrow batch so that one slice holds about ``chars`` bytes of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    at = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // max(1, chars)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
        give_back()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node): alternating large-star and small-star steps.

    Each step is a groupBy-min (combined before the shuffle) and one equi-join (AQE splits a hot
    node); rounds grow with the logarithm of the longest chain.  An empty edge table costs one job.
    The files of a step follow the number of its edges and not that of the shuffle's partitions."""
    e = stored(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == seen or not state.n:
            break
        seen = (state.n, state.h)
        kept = lambda df, name, files=-(-2 * state.n // FILE_EDGES): stored(df.coalesce(files), name)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are stored before they are joined: AQE splits a hot node between two plain exchanges only
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        e1 = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e1 = e1.unionAll(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()  # large star
        e1 = kept(e1, "large-star")
        low = kept(e1.groupBy("u").agg(F.min("v").alias("m")), "low")
        e2 = e1.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(e2.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")  # small star
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").distinct())
