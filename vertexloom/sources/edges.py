"""Edge lists: text, the compressed binary form, Matrix Market and the dispatch by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import file_extension
from ..graph import FLAGS, Graph
from ..operators.transform import remove_duplicates, symmetrize, to_undirected
from ..plans.scratch import stored

TEXT = ("el", "eli", "del", "uel")
COMPRESSED = tuple(f"{x}_gz" for x in ("el", "eli", "del", "uel"))


def read_text(spark: SparkSession, path, tags: bool = False, strict: bool = True) -> DataFrame:
    """src, dst[, etag] of lines ``src dst [tag]``; # and % begin comments, blank lines are skipped.

    A missing tag is 0.  Other lines fail the read, or are skipped with ``strict`` off."""
    raw = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v")).where(~F.col("v").rlike("^[#%]") & (F.col("v") != ""))
    f = F.split("v", " ")
    number = lambda i: F.try_element_at(f, F.lit(i)).try_cast("long")
    e = raw.select("v", number(1).alias("src"), number(2).alias("dst"), number(3).alias("etag"))
    bad = F.col("src").isNull() | F.col("dst").isNull()
    if strict:
        e = e.withColumn("src", F.when(bad, F.raise_error(F.concat(F.lit("not an edge: "), "v")).cast("long")).otherwise(F.col("src")))
    else:
        e = e.where(~bad)
    return e.select("src", "dst", *([F.coalesce("etag", F.lit(0)).cast("long").alias("etag")] if tags else []))


def read_matrix_market(spark: SparkSession, path) -> tuple[DataFrame, bool]:
    """(edges, undirected) of a coordinate file; its 1-based ids stay as they are (runs a job).

    The size line is the first one that is no comment; a symmetric, skew-symmetric or hermitian
    header means undirected."""
    from ..plans.scratch import numbered_lines

    lines = numbered_lines(spark, path)
    head = lines.where(F.col("value").startswith("%%MatrixMarket")).select("value").head(1)
    first = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).agg(F.min("line")).first()[0]
    body = lines.where((F.col("line") > first) & (F.trim("value") != ""))
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    undirected = bool(head) and any(w in head[0][0].lower() for w in ("symmetric", "hermitian"))
    # only body lines are split into numbers, whatever the order of filters
    return body.select(f[0].try_cast("long").alias("src"), f[1].try_cast("long").alias("dst")), undirected


def decode_edges(raw: bytes):
    """(flags, src, dst, tag or None) of a compressed edge list: header, then differences."""
    import gzip

    import numpy as np

    data = gzip.decompress(raw)
    flags, count = (int(x) for x in np.frombuffer(data, "<u8", 2))
    width = 3 if flags & FLAGS["TAG_E"] else 2
    rows = np.frombuffer(data, "<i8", count * width, 16).reshape(count, width)
    return flags, np.cumsum(rows[:, 0]), np.cumsum(rows[:, 1]), rows[:, 2] if width == 3 else None


def encode_edges(src, dst, tag=None) -> bytes:
    import gzip

    import numpy as np

    src, dst = np.asarray(src, "<i8"), np.asarray(dst, "<i8")
    cols = [np.diff(src, prepend=0), np.diff(dst, prepend=0)] + ([] if tag is None else [np.asarray(tag, "<i8")])
    head = np.array([FLAGS["TAG_E"] if tag is not None else 0, len(src)], "<u8").tobytes()
    return gzip.compress(head + np.stack(cols, 1).astype("<i8").tobytes(), mtime=0) if len(src) else gzip.compress(head, mtime=0)


def read_compressed(spark: SparkSession, path, tags: bool = False) -> DataFrame:
    """src, dst[, etag], file of compressed edge lists; a file is one task's (gzip can't be split)."""
    schema = "src long, dst long, etag long, file string"

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                _, s, d, t = decode_edges(raw)
                for i in range(0, max(1, len(s)), 1 << 20):
                    at = slice(i, i + (1 << 20))
                    yield pd.DataFrame({"src": s[at], "dst": d[at], "etag": np.zeros(len(s[at]), np.int64) if t is None else t[at], "file": name})

    e = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    return e if tags else e.drop("etag")


def read_graph(spark: SparkSession, path: str, tags: bool = False, form: str | None = None, strict: bool = True) -> Graph:
    """A graph from any known file, by extension or by ``form``."""
    form = (form or file_extension(path)).lower()
    if form in ("dimacs", "csr", "csc"):
        from ..operators.transform import transpose
        from .adjacency import read_adjacency

        g = read_adjacency(spark, path)
        return transpose(g) if form == "csc" else g
    if form == "mtx":
        e, undirected = read_matrix_market(spark, path)
        g = Graph.from_edges(e)
        return symmetrize(g) if undirected else g
    if form == "parquet":
        return Graph.read_parquet(spark, path)
    if form in TEXT:
        e = read_text(spark, path, tags, strict)
    elif form in COMPRESSED:
        e = read_compressed(spark, path, tags).drop("file")
    else:
        raise ValueError(f"no reader for {form!r}")
    g = Graph.from_edges(e)
    return symmetrize(g) if form.startswith("uel") else g


def prepared(g: Graph, form: str) -> Graph:
    """What a form holds: ``uel`` one direction, ``uel`` and ``del`` no duplicates (tags added)."""
    if form.startswith("uel"):
        g = to_undirected(g)
    return remove_duplicates(g) if form.startswith(("uel", "del")) else g


def write_text(g: Graph, path: str, form: str = "el", single: bool = False) -> None:
    """``src dst [tag]`` lines, a part file per task, in (src, dst) order over the parts."""
    e = prepared(g, form).edges
    cols = ["src", "dst"] + (["etag"] if "etag" in e.columns else [])
    e = e.coalesce(1).sortWithinPartitions(*cols) if single else e.repartitionByRange("src", "dst").sortWithinPartitions(*cols)
    e.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in cols)).alias("value")).write.mode("overwrite").text(path)


def compressed_chunks(g: Graph, form: str = "el_gz", rows: int = 1 << 22) -> DataFrame:
    """chunk, content: compressed edge lists of up to about ``rows`` sorted edges each, made by the tasks."""
    e = prepared(g, form).edges
    cols = ["src", "dst"] + (["etag"] if "etag" in e.columns else [])

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        held, size, k = [], 0, 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= rows:
                x = pd.concat(held)
                yield pd.DataFrame({"chunk": [TaskContext.get().partitionId() << 20 | k], "content": [encode_edges(*(x[c] for c in cols))]})
                held, size, k = [], 0, k + 1
        if size:
            x = pd.concat(held)
            yield pd.DataFrame({"chunk": [TaskContext.get().partitionId() << 20 | k], "content": [encode_edges(*(x[c] for c in cols))]})

    return e.select(*cols).repartitionByRange("src", "dst").sortWithinPartitions(*cols).mapInPandas(run, "chunk long, content binary")


def write_compressed(g: Graph, path: str, form: str = "el_gz") -> None:
    """One compressed file at ``path`` on the driver's file system, streamed chunk by chunk.

    A single gzip stream has no parallel writer; large graphs go to Parquet or to chunks."""
    import gzip

    import numpy as np

    chunks = stored(compressed_chunks(g, form), "chunks")
    e = prepared(g, form).edges
    total, last = e.count(), np.zeros(2, np.int64)
    tags = "etag" in e.columns
    with open(path, "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as out:
        out.write(np.array([FLAGS["TAG_E"] if tags else 0, total], "<u8").tobytes())
        for r in chunks.orderBy("chunk").select("content").toLocalIterator():
            _, s, d, t = decode_edges(bytes(r.content))
            cols = [np.diff(s, prepend=last[0]), np.diff(d, prepend=last[1])] + ([t] if tags else [])
            out.write(np.stack(cols, 1).astype("<i8").tobytes())
            last[:] = s[-1], d[-1]


def write_graph(g: Graph, path: str, form: str | None = None) -> None:
    form = (form or file_extension(path)).lower()
    if form in ("dimacs", "csr", "csc"):
        from .adjacency import write_adjacency

        write_adjacency(g, path, form)
    elif form in TEXT:
        write_text(g, path, form)
    elif form in COMPRESSED:
        write_compressed(g, path, form)
    elif form == "parquet":
        g.edges.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no writer for {form!r}")


def from_pairs(spark: SparkSession, pairs, n: int | None = None) -> Graph:
    """A graph from in-memory pairs (or an object with ``get_edgelist``), of the driver's own size."""
    pairs = pairs.get_edgelist() if hasattr(pairs, "get_edgelist") else pairs
    return Graph.from_edges(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long"), n)


