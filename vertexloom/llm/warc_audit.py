"""Merkle fixity audit of WARC replicas.

Records get a SHA-256 each.  Within a file they lie in offset order; ``fanout`` neighbouring
digests hash to a parent, level by level, up to one root per file, and the file roots go up the
same way to one root per replica.  An audit compares the roots and then descends: only children
of mismatching nodes are looked up at each level, so that a clean file costs one comparison and a
flipped byte one path.  Missing and added records show as nodes that only one side has.  A parent's
hash covers the positions and the number of its children, so equal contents elsewhere are a difference.

A node holds at most ``fanout`` children, so no task gathers more than that.  Offsets come from
running sums within segments of a file (an id and two digits of the digest) and over the segments' sizes.

Defined cases: null url or html serialise as empty fields; records with a null id sort first; ids
that occur twice are two records (ties by content); an empty replica has no nodes and its root is
null, equal only to another empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def to_records(pages: DataFrame, records_per_file: int = 512) -> DataFrame:
    """page_id, file, content: WARC/1.0 response records of pages, dealt to files by id range (null ids by hash)."""
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload)
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.coalesce(F.expr(f"floor(page_id / {records_per_file})").cast("long"), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(4096))).alias("file"), F.concat(head, payload, F.lit("\r\n\r\n")).alias("content"))


def digests(records: DataFrame) -> DataFrame:
    """page_id, file, pos, offset, length, sha256: one row per record, contents left behind."""
    d = records.select("page_id", "file", F.octet_length("content").cast("long").alias("length"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    # segments of a file in the same order, so that many records of one id spread over tasks
    d = stored(d.withColumn("part", F.substring("sha256", 1, 2)), "warc-digests")
    order = [F.col("page_id").asc_nulls_first(), "part"]
    size = d.groupBy("file", "page_id", "part").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    size = size.select(F.col("file").alias("f"), F.col("page_id").alias("p"), F.col("part").alias("s"), F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("bytes").over(before), zero).alias("b0"))
    w = Window.partitionBy("file", "page_id", "part").orderBy("sha256", "length")
    inner = d.select("*", (F.row_number().over(w) - 1).alias("i"), (F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("b"))
    both = inner.join(size, (F.col("file") == F.col("f")) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("part") == F.col("s")))
    return both.select("page_id", "file", (F.col("n0") + F.col("i")).cast("long").alias("pos"), (F.col("b0") + F.col("b")).alias("offset"), "length", "sha256")


def _up(nodes: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """One level up: neighbouring nodes (``fanout`` at most) hash to their parent, with their positions and number."""
    kids = F.sort_array(F.collect_list(F.struct("pos", "hash")))
    spelt = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["pos"].cast("string"), k["hash"])), ",")
    return nodes.groupBy(*keys, F.expr(f"pos div {fanout}").alias("pos")).agg(F.sha2(F.concat_ws(";", F.count("*").cast("string"), spelt).cast("binary"), 256).alias("hash"))


#: a file's place among the replica's files: 0, -1, 1, -2, 2, ... in turn, so that none is negative
PLACE = "case when file >= 0 then 2 * file else -2 * file - 1 end"
FILE = "case when pos % 2 = 0 then pos div 2 else -((pos + 1) div 2) end"


def _grow(levels: list[DataFrame], keys: list[str], fanout: int, height: int) -> list[DataFrame]:
    """Add levels until every key has one node, and up to ``height`` at least."""
    levels = list(levels)
    while len(levels) < height or not levels[-1].where("pos <> 0").isEmpty():
        levels.append(stored(_up(levels[-1], keys, fanout), "warc-level"))
    return levels


def build_tree(records: DataFrame, fanout: int = 16) -> dict:
    """The tree of one replica: ``records`` (digests) and ``levels`` of (file, pos, hash), leaves first.

    A leaf covers the record's offset, so a shifted range shows even where contents agree."""
    leaves = stored(digests(records), "warc-records")
    first = leaves.select("file", "pos", F.concat_ws(":", F.col("offset").cast("string"), "sha256").alias("hash"))
    return {"records": leaves, "levels": _grow([first], ["file"], fanout, 1), "fanout": fanout}


def _tops(tree: dict, height: int) -> list[DataFrame]:
    return _grow([tree["levels"][-1].select(F.expr(PLACE).alias("pos"), "hash")], [], tree["fanout"], height)


def root(tree: dict) -> str | None:
    got = _tops(tree, 1)[-1].select("hash").head(1)
    return got[0][0] if got else None


def audit(a: dict, b: dict) -> tuple[DataFrame, list[int]]:
    """(file, pos, status) of records that differ, and how many nodes differed at each level.

    status: ``corrupt`` (both sides have the slot), ``shifted`` (equal contents at another offset, after a
    record of another length), ``missing`` (only ``a``) or ``added`` (only ``b``)."""
    if a["fanout"] != b["fanout"]:
        raise ValueError("replicas were hashed with different fan-outs")
    fanout = a["fanout"]
    high = max(len(a["levels"]), len(b["levels"]))
    a, b = ({**t, "levels": _grow(t["levels"], ["file"], fanout, high)} for t in (a, b))
    ta, tb = _tops(a, 1), _tops(b, 1)
    high = max(len(ta), len(tb))
    ta, tb = _tops(a, high), _tops(b, high)
    counts: list[int] = []

    def compare(x: DataFrame, y: DataFrame, keys: list[str], parents: DataFrame | None) -> DataFrame:
        if parents is not None:  # only children of mismatching nodes are read on
            up = parents.withColumnRenamed("pos", "parent")
            x, y = (d.withColumn("parent", F.expr(f"pos div {fanout}")).join(up, [*keys[:-1], "parent"], "left_semi").drop("parent") for d in (x, y))
        both = x.withColumnRenamed("hash", "h1").join(y.withColumnRenamed("hash", "h2"), keys, "full")
        found = stored(both.where(~F.col("h1").eqNullSafe(F.col("h2"))), "warc-diff")
        counts.append(found.count())
        return found

    bad = None
    for x, y in zip(ta[::-1], tb[::-1]):
        bad = compare(x, y, ["pos"], None if bad is None else bad.select("pos"))
        if not counts[-1]:
            break
    if counts[-1]:
        # the file roots are at once the lowest top level and the highest level of the files
        bad = bad.select(F.expr(FILE).cast("long").alias("file"), F.lit(0).cast("long").alias("pos"), "h1", "h2")
        for x, y in list(zip(a["levels"], b["levels"]))[-2::-1]:
            bad = compare(x, y, ["file", "pos"], bad.select("file", "pos"))
    else:
        bad = a["levels"][0].limit(0).select("file", "pos", F.col("hash").alias("h1"), F.col("hash").alias("h2"))
    return bad.select("file", "pos", F.when(F.col("h2").isNull(), "missing").when(F.col("h1").isNull(), "added").when(F.substring_index("h1", ":", -1) == F.substring_index("h2", ":", -1), "shifted").otherwise("corrupt").alias("status")), counts


def audited_records(a: dict, b: dict) -> DataFrame:
    """Every record slot of ``a`` with its digest and status (``ok`` where the audit found nothing)."""
    bad, _ = audit(a, b)
    return a["records"].join(bad, ["file", "pos"], "left").select("page_id", "file", "pos", "offset", "length", "sha256", F.coalesce("status", F.lit("ok")).alias("status"))
