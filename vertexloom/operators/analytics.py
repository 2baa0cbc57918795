"""Analytics over benchmark logs and over degree and heat-map files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BENCH_SCHEMA = T.StructType([
    T.StructField("DATASET", T.StringType()), T.StructField("SOLVER", T.StringType()), T.StructField("B", T.IntegerType()), T.StructField("V", T.LongType()), T.StructField("E", T.LongType()), T.StructField("it", T.IntegerType()),
    T.StructField("time_ms", T.DoubleType()), T.StructField("init_ms", T.DoubleType()), T.StructField("base_us", T.DoubleType()), T.StructField("rank_us", T.DoubleType()), T.StructField("diff_us", T.DoubleType()), T.StructField("trans_ms", T.DoubleType()),
])
#: device families in solver names
FRAMEWORKS = {"mkl": "MKL", "ref": "CPU", "omp": "OpenMP", "ocl": "OpenCL", "cud": "CUDA", "spu": "StarPU", "mpi": "MPI"}
DEVICES = {"mkl": "CPU", "ref": "CPU", "omp": "CPU", "ocl": "GPU", "cud": "GPU", "spu": "hybrid", "mpi": "CPU"}


def read_log(spark: SparkSession, path) -> DataFrame:
    """BENCH_SCHEMA from whitespace-separated lines of one or many files; # lines and repeated
    headers are left out (logs merge by reading them together)."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)") & ~F.trim("value").startswith("DATASET"))
    return rows.select(f.alias("f")).where(F.size("f") >= len(BENCH_SCHEMA)).select(*(F.col("f")[i].try_cast(x.dataType).alias(x.name) for i, x in enumerate(BENCH_SCHEMA)))


def log_rows(spark: SparkSession, dataset: str, solver: str, blocks: int, n: int, m: int, result) -> DataFrame:
    """The log row of a timed run."""
    s = result.seconds
    row = (dataset, solver, blocks, n, m, result.iterations, s.get("rank", 0.0) * 1e3, s.get("init", 0.0) * 1e3, 0.0, s.get("rank", 0.0) * 1e6, 0.0, 0.0)
    return spark.createDataFrame([row], BENCH_SCHEMA)


def clean(log: DataFrame, pattern: str | None = None) -> DataFrame:
    """Rows without nulls whose solver matches ``pattern``, averaged per dataset, blocks, iterations and solver."""
    rows = log.na.drop()
    if pattern:
        rows = rows.where(F.col("SOLVER").rlike(pattern))
    means = [F.avg(c).alias(c) for c in ("time_ms", "init_ms", "base_us", "rank_us", "diff_us", "trans_ms")]
    return rows.groupBy("DATASET", "B", "it", "SOLVER").agg(F.max("V").alias("V"), F.max("E").alias("E"), *means)


def mapped(column: Column, names: dict[str, str]) -> Column:
    """Look-up in a literal dictionary; itself where absent."""
    if not names:
        return column
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def with_names(log: DataFrame, datasets: dict[str, str] | None = None) -> DataFrame:
    """datagroup, framework, method and flow from the names, with device and labels."""
    part = r"^(?:pr_)?(p?b?csc|p?b?csr)_([a-z]+)_([a-z]+)"
    out = log.withColumns({
        "DATAGROUP": F.regexp_extract("DATASET", r"^([A-Za-z]+)", 1), "LAYOUT": F.regexp_extract("SOLVER", part, 1), "FRAMEWORK": F.regexp_extract("SOLVER", part, 2), "METHOD": F.regexp_extract("SOLVER", part, 3),
    })
    flow = F.when(F.col("LAYOUT").endswith("csc"), "pull").when(F.col("LAYOUT").endswith("csr"), "push")
    return out.withColumns({"FLOW": flow, "KERNEL": mapped(F.col("FRAMEWORK"), FRAMEWORKS), "DEVICE": mapped(F.col("FRAMEWORK"), DEVICES), "GRAPH": mapped(F.col("DATASET"), datasets or {})})


def with_group_size(log: DataFrame, group: str = "DATAGROUP", member: str = "DATASET") -> DataFrame:
    """The group's label with its number of distinct members appended."""
    sizes = log.groupBy(group).agg(F.count_distinct(member).alias("members"))
    return log.join(sizes, group).withColumn("LABEL", F.concat(group, F.lit(" ("), F.col("members").cast("string"), F.lit(")")))


def with_metrics(log: DataFrame) -> DataFrame:
    """Per iteration: it_ms; edges a second; EPS and PS in 10^9 edges and vertices; mean degree."""
    t = F.col("time_ms") / F.col("it")
    return log.withColumns({"it_ms": t, "edges_per_sec": F.try_divide(F.col("E") * 1e3, t), "EPS": F.try_divide(F.col("E") / 1e6, t), "PS": F.try_divide(F.col("V") / 1e6, t), "mean_degree": F.try_divide(F.col("E").cast("double"), F.col("V").cast("double"))})


def with_stats(log: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join of the means of per-dataset statistics (DATASET and numbers)."""
    numbers = [c for c, t in stats.dtypes if c != "DATASET" and t in ("int", "bigint", "double", "float")]
    return log.join(stats.groupBy("DATASET").agg(*(F.avg(c).alias(c) for c in numbers)), "DATASET", "left")


def union(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def best(log: DataFrame, by: list[str], value: str = "EPS") -> DataFrame:
    return log.groupBy(*by).agg(F.max(value).alias(value)).orderBy(F.col(value).desc(), *by)


def spread(log: DataFrame, by: list[str], value: str = "EPS") -> DataFrame:
    """mean and sample standard deviation per group."""
    return log.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def baseline_ratio(log: DataFrame, value: str = "EPS", column: str = "B", base: int = 1) -> DataFrame:
    """The value over that of the same dataset and solver at the baseline."""
    b = log.where(F.col(column) == base).groupBy("DATASET", "SOLVER").agg(F.avg(value).alias("base"))
    return log.join(b, ["DATASET", "SOLVER"]).withColumn("ratio", F.try_divide(F.col(value), F.col("base")))


def lorenz(hist: DataFrame, weight: str = "n", order: str = "deg") -> DataFrame:
    """order, share: the running share of the weight (the table has one row per distinct value)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = hist.agg(F.sum(weight).alias("t"))
    return hist.join(F.broadcast(total)).select(order, F.try_divide(F.sum(weight).over(w).cast("double"), F.col("t").cast("double")).alias("share"))


def half_point(curve: DataFrame, order: str = "deg", at: float = 0.5) -> DataFrame:
    return curve.where(F.col("share") >= at).agg(F.min(order).alias("half"))


def fences(values: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """One row: quartiles and the outlier fences ``k`` spreads beyond them."""
    one = values.agg(F.percentile(column, F.lit(0.25)).alias("q25"), F.percentile(column, F.lit(0.75)).alias("q75"))
    return one.select("q25", "q75", (F.col("q25") - k * (F.col("q75") - F.col("q25"))).alias("lo"), (F.col("q75") + k * (F.col("q75") - F.col("q25"))).alias("hi"))


def percentile_bins(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """The rows with the bin of equal counts that their value falls in, 0 to bins - 1."""
    cuts = values.agg(F.percentile(column, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("cuts"))
    return values.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: F.col(column) > c))).drop("cuts")


def weighted(values: DataFrame, x: str, w: str) -> DataFrame:
    """One row: weighted mean and standard deviation."""
    sw, sx, sxx = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(x) * F.col(x))
    m = F.try_divide(sx, sw)
    return values.agg(m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(sxx, sw) - m * m)).alias("std"))


def loglog_fit(hist: DataFrame, x: str = "deg", y: str = "n") -> DataFrame:
    """One row: slope and intercept of log2(y + 1) over log2(x + .5), residuals weighted by log2(y + 1)."""
    a, b = F.log2(F.col(x) + 0.5), F.log2(F.col(y) + 1.0)
    w = b * b
    s = hist.agg(F.sum(w).alias("w"), F.sum(w * a).alias("wx"), F.sum(w * b).alias("wy"), F.sum(w * a * a).alias("wxx"), F.sum(w * a * b).alias("wxy"))
    slope = F.try_divide(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    return s.withColumn("slope", slope).select("slope", F.try_divide(F.col("wy") - F.col("slope") * F.col("wx"), F.col("w")).alias("intercept"))


def normality(values: DataFrame, column: str) -> DataFrame:
    """One row: D'Agostino's K^2 from skewness and kurtosis, and its chi-square probability."""
    import math

    r = values.agg(F.count(column).alias("n"), F.skewness(column).alias("g"), F.kurtosis(column).alias("k")).first()
    n, k2 = r.n, None
    if n >= 20 and r.g is not None:
        y = r.g * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
        beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = -1 + math.sqrt(2 * (beta - 1))
        zs = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
        x = (r.k + 3 - 3 * (n - 1) / (n + 1)) / math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
        b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        a = 6 + 8 / b * (2 / b + math.sqrt(1 + 4 / b**2))
        d = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
        zk = (1 - 2 / (9 * a) - math.copysign(abs(d) ** (1 / 3), d)) / math.sqrt(2 / (9 * a))
        k2 = zs * zs + zk * zk
    return values.sparkSession.createDataFrame([(n, k2, None if k2 is None else math.exp(-k2 / 2))], "n long, k2 double, p double")
