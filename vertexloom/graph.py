"""A graph: a table of edges, an explicit number of vertices and optional vertex columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: optional columns and the bit of each in file headers (fixed values of the file format)
FLAGS = {"PIN": 1, "SORT": 2, "TAG_V": 4, "TAG_E": 8, "VAL_V": 16, "VAL_E": 32, "DEG_I": 64, "DEG_O": 128}


@dataclass(frozen=True)
class Graph:
    """Directed multigraph over vertices 0..n-1.

    ``edges``: src, dst (long) and optionally etag (long) and further value columns.  ``n`` counts
    isolated vertices too, so it travels with the graph.  ``vertex_data``: id and optional columns
    (vtag, values); absent ids read as tag 0.  Null endpoints are no edges and are dropped by
    :meth:`from_edges`; duplicates and loops are legal and counted until removed."""

    edges: DataFrame
    n: int
    vertex_data: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, edges: DataFrame, n: int | None = None, src: str = "src", dst: str = "dst", etag: str | None = None) -> "Graph":
        """Vertices run to the largest endpoint, gaps being isolated, unless ``n`` says more."""
        keep = [F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")]
        if etag or "etag" in edges.columns:
            keep.append(F.coalesce(F.col(etag or "etag"), F.lit(0)).cast("long").alias("etag"))
        e = edges.select(*keep).where("src is not null and dst is not null")
        if n is None:
            top = e.agg(F.max(F.greatest("src", "dst"))).first()[0]
            n = 0 if top is None else int(top) + 1
        return cls(e, n)

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str, **how) -> "Graph":
        return cls.from_edges(spark.read.parquet(path), **how)

    def with_edges(self, edges: DataFrame, n: int | None = None) -> "Graph":
        return replace(self, edges=edges, n=self.n if n is None else n)

    @property
    def has_etag(self) -> bool:
        return "etag" in self.edges.columns

    def vertices(self) -> DataFrame:
        """id and the vertex columns, one row for each of 0..n-1."""
        ids = self.spark.range(self.n)
        if self.vertex_data is None:
            return ids
        out = ids.join(self.vertex_data, "id", "left")
        return out.withColumn("vtag", F.coalesce("vtag", F.lit(0).cast("long"))) if "vtag" in out.columns else out

    def edge_count(self) -> int:
        return self.edges.count()

    def create_views(self, prefix: str = "graph") -> None:
        """Temp views <prefix>_edges and <prefix>_vertices for plain SQL."""
        self.edges.createOrReplaceTempView(f"{prefix}_edges")
        self.vertices().createOrReplaceTempView(f"{prefix}_vertices")

    def flags(self) -> int:
        cols = set(self.edges.columns) | set(self.vertex_data.columns if self.vertex_data is not None else [])
        return sum(FLAGS[f] for f, c in (("TAG_V", "vtag"), ("TAG_E", "etag"), ("VAL_V", "vval"), ("VAL_E", "eval")) if c in cols)

    def equals(self, other: "Graph") -> bool:
        """Same vertex count, same bag of edges and same vertex rows."""
        if self.n != other.n or set(self.edges.columns) != set(other.edges.columns):
            return False
        cols = self.edges.columns
        a, b = self.edges.select(*cols), other.edges.select(*cols)
        if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
            return False
        va, vb = self.vertices(), other.vertices()
        if set(va.columns) != set(vb.columns):
            return False
        vb = vb.select(*va.columns)
        return va.exceptAll(vb).isEmpty() and vb.exceptAll(va).isEmpty()

    def copy(self, etag: bool = True, vtag: bool = True) -> "Graph":
        """A copy with a subset of the optional columns."""
        e = self.edges if etag else self.edges.drop("etag")
        v = self.vertex_data if vtag or self.vertex_data is None else self.vertex_data.drop("vtag")
        return replace(self, edges=e, vertex_data=v)
