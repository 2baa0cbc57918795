"""Token counts from flat token files without an index, by scanning for separators.

A file is a stream of token ids cut into blocks of a fixed size; documents end with an
end-of-document id and may run over any number of blocks.  One vectorised scan per block finds the
separators; a prefix scan over the block summaries (a few numbers per block, windows per segment of a
file, then over its segments) gives every block its start in the stream, the number of documents ended
before it and where the open document began; documents are stitched from that, so no block needs its
neighbours' tokens.

Defined cases: a null block is an empty one; consecutive separators make documents of zero tokens;
tokens after a file's last separator form a last document marked ``open``; an empty table gives no
documents; repeated block numbers of a file are an error of the input and count as two blocks in
any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import read_ranks
from .common import stored, text_slices

#: about so many bytes of token files are read by one task
TASK_BYTES = 16 << 20
#: blocks that the prefix scan sums in one group
SEGMENT = 4096


def write_token_blocks(docs: DataFrame, rank_file: str, pattern: str, eod: int, block_tokens: int = 1 << 18) -> DataFrame:
    """file, block, tokens (little-endian 16-bit ids), doc_ids: the stream of each partition.

    ``doc_ids`` lists the documents that end in a block, in order, as a check beside the stream;
    the scan doesn't read it.  A file is what one partition of ``docs`` holds; null text: empty."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))  # the driver's file; some 2 MB
    schema = f"file long, block long, tokens binary, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import tiktoken
        from pyspark import TaskContext

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        file = TaskContext.get().partitionId()
        open_ids, waiting, ended, block = [], 0, [], 0

        def flush(last=False):
            nonlocal waiting, block, open_ids, ended
            while waiting >= block_tokens or (last and waiting):
                stream = np.concatenate(open_ids)
                cut, rest = stream[:block_tokens], stream[block_tokens:]
                here = sum(1 for end, _ in ended if end <= len(cut))
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([cut.tobytes()], pa.binary()), pa.array([[d for _, d in ended[:here]]], pa.list_(id_type))], names=["file", "block", "tokens", "doc_ids"])
                ended = [(e - len(cut), d) for e, d in ended[here:]]
                open_ids, waiting, block = [rest], len(rest), block + 1

        for whole in batches:
            id_type = whole.column(whole.schema.get_field_index("doc_id")).type
            for b in text_slices(whole, "text", 2 << 20):
                for d, t in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), b.column(b.schema.get_field_index("text")).to_pylist()):
                    got = enc.encode_ordinary(t or "")
                    got.append(eod)
                    open_ids.append(np.array(got, "<u2"))
                    waiting += len(got)
                    ended.append((waiting, d))
                    if waiting >= block_tokens:
                        yield from flush()
        if waiting:
            yield from flush(True)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def arrow_uri(spark: SparkSession, path: str) -> str:
    """The uri of an existing path in the store that holds it, mount points followed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(p).toUri().toString()


def write_token_files(docs: DataFrame, path: str, rank_file: str, pattern: str, eod: int) -> DataFrame:
    """Write a flat file ``part-N.bin`` of little-endian 16-bit ids per partition of ``docs`` to the
    folder ``path``, which all executors reach; returns file (N), doc (ordinal in the file), doc_id.

    The files hold ids and separators alone; the returned names are for the caller, the scan doesn't
    read them.  A file appears under its name once it is whole.  Null text: empty."""
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    uri = arrow_uri(spark, path)
    shared = spark.sparkContext.broadcast(read_ranks(rank_file))  # the driver's file; some 2 MB

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import tiktoken
        from pyarrow import fs
        from pyspark import TaskContext

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        task = TaskContext.get()
        file, doc, out = task.partitionId(), 0, None
        store, base = fs.FileSystem.from_uri(uri)
        name, part = f"{base}/part-{file:05d}.bin", f"{base}/_part-{file:05d}-{task.taskAttemptId()}"
        for whole in batches:
            for b in text_slices(whole, "text", 2 << 20):
                out = out or store.open_output_stream(part)
                for t in b.column(b.schema.get_field_index("text")).to_pylist():
                    out.write(np.array([*enc.encode_ordinary(t or ""), eod], "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, file, np.int64)), pa.array(np.arange(doc, doc + b.num_rows)), b.column(b.schema.get_field_index("doc_id"))], names=["file", "doc", "doc_id"])
                doc += b.num_rows
        if out:
            out.close()
            if store.get_file_info(name).type != fs.FileType.NotFound:  # of an attempt that was lost after it
                store.delete_file(name)
            store.move(part, name)

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"file long, doc long, doc_id {docs.schema['doc_id'].dataType.simpleString()}"), "token-names")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = 1 << 18) -> DataFrame:
    """file (name), block, tokens of flat files of any length, read by byte ranges.

    The driver lists names and lengths only; a task seeks to its blocks.  Stores that Arrow cannot open
    are read by Spark, whole files at a time, which fails on a file of 2 GB or more."""
    from pyarrow import fs

    whole = spark.read.format("binaryFile").load(path)
    step = block_tokens * width
    files = [(r.path, r.length) for r in whole.select("path", "length").orderBy("path").collect()]
    try:
        uris = [arrow_uri(spark, f) for f, _ in files]
        for u in uris[:1]:
            fs.FileSystem.from_uri(u)
    except (OSError, ValueError):
        cut = whole.select(F.col("path").alias("file"), "content", F.explode(F.expr(f"sequence(0L, greatest(0L, (length - 1) div {step}))")).alias("block"))
        return cut.select("file", "block", F.expr(f"substring(content, cast(block * {step} + 1 as int), {step})").alias("tokens"))
    first = [0]  # each file's first block among all
    for _, n in files:
        first.append(first[-1] + max(1, -(-n // step)))
    listed = spark.sparkContext.broadcast((files, uris, first))

    def run(batches):
        from bisect import bisect_right

        import pyarrow as pa

        files, uris, first = listed.value
        at, source = None, None
        for batch in batches:
            for i in batch.column(0).to_pylist():
                k = bisect_right(first, i) - 1
                if k != at:
                    store, name = fs.FileSystem.from_uri(uris[k])
                    at, source = k, store.open_input_file(name)
                block = i - first[k]
                n = min(step, files[k][1] - block * step)
                got = source.read_at(n, block * step)
                if len(got) != n:
                    raise OSError(f"{files[k][0]} is shorter than listed")
                yield pa.RecordBatch.from_arrays([pa.array([files[k][0]]), pa.array([block], pa.int64()), pa.array([got], pa.binary())], names=["file", "block", "tokens"])

    tasks = max(1, -(-first[-1] * step // TASK_BYTES))
    return spark.range(0, first[-1], 1, min(tasks, max(1, first[-1]))).mapInArrow(run, "file string, block long, tokens binary")


def scan_blocks(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """The columns of ``blocks`` but tokens, with n (ids in the block) and ends (separators' places)."""
    from pyspark.sql import types as T

    keep = [c for c in blocks.columns if c not in ("tokens", "n", "ends")]
    schema = T.StructType([blocks.schema[c] for c in keep] + [T.StructField("n", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            got = [np.frombuffer(x or b"", f"<u{width}") for x in b.column(b.schema.get_field_index("tokens")).to_pylist()]
            ends = [np.flatnonzero(x == eod) for x in got]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array([len(x) for x in got], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=[*keep, "n", "ends"])

    return blocks.mapInArrow(run, schema)


def _prefix_scan(blocks: DataFrame) -> DataFrame:
    """file, row, n, last, count, block of block summaries, with first (ids before the block), before
    (documents ended before it) and began (start of the document that is open at its start).

    Blocks are summed within segments and segments within their file, so that a task sorts at most
    ``SEGMENT`` blocks, or a file's segments; only these fixed-width rows move."""
    prior = Window.partitionBy("file", "segment").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    s = blocks.withColumn("segment", F.floor(F.col("block") / SEGMENT))
    s = s.withColumn("first", F.coalesce(F.sum("n").over(prior), F.lit(0).cast("long"))).withColumn("before", F.coalesce(F.sum("count").over(prior), F.lit(0).cast("long")))
    s = s.withColumn("closed", F.col("first") + F.col("last"))
    s = s.withColumn("began", F.max("closed").over(prior) + 1)
    earlier = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    t = s.groupBy("file", "segment").agg(F.sum("n").alias("n"), F.sum("count").alias("count"), F.max("closed").alias("closed"))
    t = t.withColumn("ids", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))
    t = t.select(F.col("file").alias("of"), F.col("segment").alias("at"), "ids", F.coalesce(F.sum("count").over(earlier), F.lit(0).cast("long")).alias("docs"), F.max(F.col("ids") + F.col("closed")).over(earlier).alias("closed_before"))
    both = s.join(t, F.col("file").eqNullSafe(F.col("of")) & F.col("segment").eqNullSafe(F.col("at")))
    began = F.coalesce(F.col("ids") + F.col("began"), F.col("closed_before") + 1, F.lit(0).cast("long"))
    return both.select("file", "row", "block", "n", "last", "count", (F.col("ids") + F.col("first")).alias("first"), (F.col("docs") + F.col("before")).alias("before"), began.alias("began"))


def count_documents(scanned: DataFrame) -> DataFrame:
    """file, doc (ordinal in the file), start, n_tokens, open, block and i (its place among the block's).

    The scan's rows (separators' places, a few bytes a document) are written to the shared folder
    once, each under a number; the prefix scan reads their summaries and is joined back by number."""
    rows = stored(scanned.select("file", "block", "n", "ends", F.monotonically_increasing_id().alias("row")), "token-scan")
    placed = _prefix_scan(rows.select("file", "block", "row", "n", F.size("ends").cast("long").alias("count"), F.array_max("ends").alias("last")))
    each = rows.select("row", "ends").where(F.size("ends") > 0).join(placed.select("file", "block", "row", "first", "before", "began"), "row")
    each = each.select("file", "block", "before", "began", "first", F.posexplode("ends").alias("i", "end"), "ends")
    start = F.when(F.col("i") == 0, F.col("began")).otherwise(F.col("first") + F.get("ends", F.col("i") - 1) + 1)
    closed = each.select("file", (F.col("before") + F.col("i")).alias("doc"), start.alias("start"), (F.col("first") + F.col("end") - start).alias("n_tokens"), F.lit(False).alias("open"), "block", "i")
    tail = placed.groupBy("file").agg(F.max(F.col("first") + F.col("n")).alias("all"), F.max(F.col("first") + F.col("last") + 1).alias("end"), F.sum("count").alias("doc"), F.max("block").alias("block"))
    tail = tail.withColumn("end", F.coalesce("end", F.lit(0).cast("long"))).where("all > end")
    return closed.unionAll(tail.select("file", "doc", F.col("end").alias("start"), (F.col("all") - F.col("end")).alias("n_tokens"), F.lit(True).alias("open"), "block", F.lit(None).cast("int").alias("i")))


def token_counts(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    return count_documents(scan_blocks(blocks, eod, width))
