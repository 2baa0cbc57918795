"""Small graphs with values worked out by hand from the definitions."""

H1 = [(0, 1), (0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 3), (6, 0)]
H2 = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (4, 0)]


def graph(spark, pairs, n=None):
    from vertexloom.graph import Graph

    return Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"), n)


def pairs(df):
    return sorted((r.src, r.dst) for r in df.select("src", "dst").collect())


def column(df, by, value):
    return [r[value] for r in df.orderBy(by).collect()]
