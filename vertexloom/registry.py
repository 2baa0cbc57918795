"""Registered graph queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .graph import Graph
from .operators import analytics as A
from .operators import generate as G
from .operators import partition as P
from .operators import stats as St
from .operators import tokens as Tok
from .operators import transform as T
from .plans import pagerank as PR
from .plans.scratch import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return put


# --- graphs derived from the tables -----------------------------------------------------------------------------------


def g_parts(spark: SparkSession, sf: str) -> Graph:
    """Parts to suppliers in one id space, tagged with the line number: loops and duplicates."""
    e = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").cast("long").alias("etag"))
    return Graph.from_edges(e)


def g_clean(spark: SparkSession, sf: str) -> Graph:
    g = T.remove_duplicates(T.remove_loops(g_parts(spark, sf)))
    return g


def g_trade(spark: SparkSession, sf: str) -> Graph:
    """Customers to suppliers: bipartite, suppliers dangling."""
    sizes = spark.read.parquet(f"{sf}/customer.parquet").agg((F.max("c_custkey") + 1).alias("c")).first().c
    supp = spark.read.parquet(f"{sf}/supplier.parquet").agg((F.max("s_suppkey") + 1).alias("s")).first().s
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("src"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") + F.lit(sizes)).alias("dst"))
    return Graph(o.join(li, "o_orderkey").select("src", "dst"), sizes + supp)


def g_seq(spark: SparkSession, sf: str) -> Graph:
    """Each event to its user's next."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    n = ev.agg(F.max("event_id") + 1).first()[0]
    return Graph(ev.select(F.col("event_id").alias("src"), nxt.alias("dst")).where("dst is not null"), n)


def g_bip(spark: SparkSession, sf: str) -> Graph:
    """Users to event types: extreme in-degrees."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type")
    users = ev.agg(F.max("user_id") + 1).first()[0]
    kinds = ev.select("event_type").distinct().select("event_type", F.row_number().over(Window.orderBy("event_type")).cast("long").alias("k"))
    e = ev.join(F.broadcast(kinds), "event_type").select(F.col("user_id").alias("src"), (F.col("k") - 1 + F.lit(users)).alias("dst"), F.lit(1).cast("long").alias("etag"))
    return Graph(e, users + kinds.count())


def g_geo(spark: SparkSession, sf: str) -> Graph:
    """Nations to regions, customers and suppliers to nations: a forest."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    r, na, c, s = read("region").count(), read("nation").count(), read("customer").count(), read("supplier").count()
    e = read("nation").select((F.col("n_nationkey") + F.lit(r)).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    e = e.unionAll(read("customer").select((F.col("c_custkey") + F.lit(r + na)).cast("long"), (F.col("c_nationkey") + F.lit(r)).cast("long")))
    e = e.unionAll(read("supplier").select((F.col("s_suppkey") + F.lit(r + na + c)).cast("long"), (F.col("s_nationkey") + F.lit(r)).cast("long")))
    return Graph(e, r + na + c + s)


E_PARTS = "e as (select l_partkey as src, l_suppkey as dst, cast(l_linenumber as bigint) as etag from lineitem), n as (select greatest(max(src), max(dst)) + 1 as n from e)"
E_CLEAN = E_PARTS.replace("e as (", "e0 as (", 1).replace(", n as (select greatest(max(src), max(dst)) + 1 as n from e)", ", n as (select greatest(max(src), max(dst)) + 1 as n from e0), e as (select src, dst, cast(sum(etag) as bigint) as etag from e0 where src <> dst group by src, dst)")
E_TRADE = "e as (select o_custkey as src, l_suppkey + (select max(c_custkey) + 1 from customer) as dst from orders join lineitem on o_orderkey = l_orderkey), n as (select (select max(c_custkey) + 1 from customer) + (select max(s_suppkey) + 1 from supplier) as n)"
E_SEQ = "e as (select * from (select event_id as src, lead(event_id) over (partition by user_id order by ts, event_id) as dst from events) where dst is not null), n as (select max(event_id) + 1 as n from events)"
E_BIP = "kinds as (select event_type, row_number() over (order by event_type) - 1 as k from (select distinct event_type from events)), u as (select max(user_id) + 1 as u from events), e as (select user_id as src, k + u as dst, cast(1 as bigint) as etag from events join kinds using (event_type) cross join u), n as (select u + (select count(*) from kinds) as n from u)"
E_GEO = """s as (select (select count(*) from region) as r, (select count(*) from nation) as na, (select count(*) from customer) as c, (select count(*) from supplier) as sp),
e as (select n_nationkey + r as src, cast(n_regionkey as bigint) as dst from nation, s union all select c_custkey + r + na, c_nationkey + r from customer, s union all select s_suppkey + r + na + c, s_nationkey + r from supplier, s),
n as (select r + na + c + sp as n from s)"""
_DEG = "v as (select unnest(range((select n from n))) as id)"


def _deg_sql(e: str, side: str) -> str:
    ends = {"out": "select src as id from e", "in": "select dst as id from e", "both": "select src as id from e union all select dst from e"}[side]
    return f"with {e}, {_DEG}, d as (select id, count(*) as deg from ({ends}) group by id) select v.id, coalesce(deg, 0) as deg from v left join d using (id)"


# --- degrees ------------------------------------------------------------------------------------------------------------

for _name, _side, _f in (("deg_out", "out", St.out_degree), ("deg_in", "in", St.in_degree), ("deg_both", "both", St.degree)):
    query(_deg_sql(E_PARTS, _side), _name)(lambda spark, sf, f=_f: f(g_parts(spark, sf)))
query(_deg_sql(E_GEO, "both"), "deg_both_forest")(lambda spark, sf: St.degree(g_geo(spark, sf)))
query(_deg_sql(E_SEQ, "out"), "deg_out_chains")(lambda spark, sf: St.out_degree(g_seq(spark, sf)))


@query(f"with d as ({_deg_sql(E_CLEAN, 'out')}), c as (select deg, count(*) as n from d group by deg) select r.deg, coalesce(c.n, 0) as n from (select unnest(range((select max(deg) + 1 from d))) as deg) r left join c using (deg)")
def deg_hist(spark, sf):
    """Flagship: loops and duplicates out, then the dense histogram of out-degrees."""
    return St.histogram(St.out_degree(g_clean(spark, sf)))


@query(f"with d as ({_deg_sql(E_BIP, 'in')}), c as (select deg, count(*) as n from d group by deg) select r.deg, coalesce(c.n, 0) as n from (select unnest(range((select max(deg) + 1 from d))) as deg) r left join c using (deg)")
def deg_hist_dense(spark, sf):
    return St.histogram(St.in_degree(g_bip(spark, sf)))


def _summary_sql(values: str) -> str:
    pick = {q: (f"n * {q} // 100" if e == "low" else f"n - 1 - n * {100 - q} // 100") for q, e in St.QUANTILES.items()}
    cols = ", ".join(f"cast(max(case when rk = {x} then deg end) as bigint) as p{q}" for q, x in pick.items())
    return f"with d as ({values}), r as (select deg, row_number() over (order by deg) - 1 as rk, count(*) over () as n from d), o as (select avg(deg) as avg, stddev_pop(deg) as stddev, {cols} from r) select round(avg, 6) as avg, round(stddev, 6) as stddev, round(3 * (avg - p50) / stddev, 6) as skewness, " + ", ".join(f"p{q}" for q in St.QUANTILES) + " from o"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


query(_summary_sql(_deg_sql(E_PARTS, "both")), "deg_summary")(lambda spark, sf: _rounded(St.summary(St.degree(g_parts(spark, sf)))))
query(_summary_sql(f"select n as deg from ({ORACLE['deg_hist']})"), "deg_summary_of_hist")(lambda spark, sf: _rounded(St.summary(deg_hist(spark, sf), "n")))
query(f"with {E_PARTS} select brow, bcol, id, count(*) as deg from (select cast((src // 32) % 4 as int) as brow, cast((dst // 32) % 4 as int) as bcol, src as id from e) group by all", "deg_by_block")(lambda spark, sf: St.block_degree(g_parts(spark, sf), 4))

# --- transforms ---------------------------------------------------------------------------------------------------------


def _edges(name: str, f, sql: str):
    query(sql, name)(lambda spark, sf: f(spark, sf).edges)


_edges("transpose", lambda s, d: T.transpose(g_parts(s, d)), f"with {E_PARTS} select dst as src, src as dst, etag from e")
_edges("symmetrize", lambda s, d: T.symmetrize(g_parts(s, d)), f"with {E_PARTS} select src, dst, etag from e union all select dst, src, etag from e")
_edges("undirected_upper", lambda s, d: T.to_undirected(g_parts(s, d)), f"with {E_PARTS} select src, dst, etag from e where src <= dst")
_edges("undirected_lower", lambda s, d: T.to_undirected(g_parts(s, d), "lower"), f"with {E_PARTS} select src, dst, etag from e where dst <= src")
_edges("dedupe_sum_tag", lambda s, d: T.remove_duplicates(g_parts(s, d)), f"with {E_PARTS} select src, dst, cast(sum(etag) as bigint) as etag from e group by src, dst")
_edges("dedupe_max_tag", lambda s, d: T.remove_duplicates(g_bip(s, d), F.max), f"with {E_BIP} select src, dst, max(etag) as etag from e group by src, dst")
_edges("remove_loops", lambda s, d: T.remove_loops(g_parts(s, d)), f"with {E_PARTS} select src, dst, etag from e where src <> dst")
_MAP = "used as (select distinct id from (select src as id from e union all select dst from e)), m as (select id, row_number() over (order by id) - 1 as nid from used)"
_edges("remove_unconnected_relabel", lambda s, d: T.remove_unconnected(T.mapped_copy(g_parts(s, d), F.col("src") % 3 == 0, src=F.col("src") * 2)), f"with e1 as (select l_partkey * 2 as src, l_suppkey as dst, cast(l_linenumber as bigint) as etag from lineitem where l_partkey % 3 = 0), e as (select * from e1), {_MAP} select a.nid as src, b.nid as dst, etag from e join m a on src = a.id join m b on dst = b.id")
_edges("sort_by_outdegree", lambda s, d: T.sort_by_degree(g_parts(s, d)), f"with {E_PARTS}, {_DEG}, d as (select src as id, count(*) as deg from e group by src), m as (select v.id, row_number() over (order by coalesce(deg, 0) desc, v.id) - 1 as nid from v left join d using (id)) select a.nid as src, b.nid as dst, etag from e join m a on src = a.id join m b on dst = b.id")
_edges("align_edges", lambda s, d: T.align_edges(g_parts(s, d), 8, 1 << 40), f"with {E_PARTS}, d as (select src, count(*) as c from e group by src) select src, dst, etag from e union all select src, n - 1 as dst, 0 as etag from (select src, unnest(range((8 - c % 8) % 8)) from d), n")
_edges("shift_vertices", lambda s, d: T.shift_vertices(g_parts(s, d), 7), f"with {E_PARTS} select src + 7 as src, dst + 7 as dst, etag from e")
_edges("rebase_vertices", lambda s, d: T.rebase_vertices(T.shift_vertices(g_seq(s, d), 100), 5), f"with {E_SEQ}, lo as (select least(min(src), min(dst)) as lo from e) select src - lo + 5 as src, dst - lo + 5 as dst from e, lo")
_edges("insert_vertices", lambda s, d: T.insert_vertices(g_parts(s, d), 50, 10), f"with {E_PARTS} select case when src >= 50 then src + 10 else src end as src, case when dst >= 50 then dst + 10 else dst end as dst, etag from e")
_edges("add_edges", lambda s, d: T.add_edges(g_parts(s, d), [(1, 2), (3, 3)], 2), f"with {E_PARTS} select * from e union all select * from (values (1, 2, 0), (1, 2, 0), (3, 3, 0), (3, 3, 0))")
_edges("mapped_copy_filter", lambda s, d: T.mapped_copy(g_parts(s, d), F.col("etag") <= 3, src=F.col("src") % 100, dst=F.col("dst") + 100), f"with {E_PARTS} select src % 100 as src, dst + 100 as dst, etag from e where etag <= 3")
_edges("clear_tags", lambda s, d: T.clear_tags(g_parts(s, d)), f"with {E_PARTS} select src, dst, cast(0 as bigint) as etag from e")
_edges("set_edge_tag", lambda s, d: T.set_edge_tag(g_clean(s, d), 3, 5, 99), f"with {E_CLEAN} select src, dst, case when src = 3 and dst = 5 then 99 else etag end as etag from e")
_edges("sanitize_dimacs", lambda s, d: T.sanitize(g_parts(s, d), no_loops=True, directed=True, unique=True, connected=True), f"with {E_PARTS.replace('e as', 'e0 as', 1).replace('from e)', 'from e0)')}, e as (select src, dst, cast(sum(etag) as bigint) as etag from (select * from e0 where src <> dst union all select dst, src, etag from e0 where src <> dst) group by src, dst), {_MAP} select a.nid as src, b.nid as dst, etag from e join m a on src = a.id join m b on dst = b.id")
_edges("sanitize_lqc", lambda s, d: T.sanitize(g_trade(s, d), no_loops=True, unique=True, connected=True), f"with {E_TRADE.replace('e as', 'e0 as', 1)}, e as (select distinct src, dst from e0 where src <> dst), {_MAP} select a.nid as src, b.nid as dst from e join m a on src = a.id join m b on dst = b.id")


@query(f"with {E_PARTS} select least(min(src), min(dst)) as lo, greatest(max(src), max(dst)) as hi from e")
def vertex_range(spark, sf):
    return T.vertex_range(g_parts(spark, sf))


@query(f"with {E_PARTS} select distinct p.src, p.dst from (select user_id as src, cast(event_id % 100 as bigint) as dst from events) p join e on e.src = p.src and e.dst = p.dst")
def edge_exists(spark, sf):
    pairs = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("src"), (F.col("event_id") % 100).alias("dst")).distinct()
    return T.edge_exists(g_parts(spark, sf), pairs)


@query(f"with {E_CLEAN} select src, dst, row_number() over (order by src, dst) - 1 as idx from e")
def edge_index(spark, sf):
    return T.edge_index(g_clean(spark, sf)).select("src", "dst", "idx")


@query(f"with d as ({_deg_sql(E_PARTS, 'out')}) select id, cast(coalesce(sum(deg) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as first from d union all select n, (select count(*) from lineitem) from (select greatest(max(l_partkey), max(l_suppkey)) + 1 as n from lineitem)")
def csr_row_index(spark, sf):
    return T.row_index(g_parts(spark, sf))


@query(f"with {E_CLEAN}, {_DEG} select v.id, coalesce(string_agg(cast(dst as varchar), ' ' order by dst), '') as neighbours from v left join e on e.src = v.id group by v.id")
def adjacency_lists(spark, sf):
    return T.adjacency(g_clean(spark, sf)).select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"))


@query(f"with {E_CLEAN}, {_DEG}, t as (select v.id, coalesce(string_agg(cast(dst + 1 as varchar) || ' ' || cast(etag as varchar), ' ' order by dst), '') as line from v left join e on e.src = v.id group by v.id) select id + 1 as row, line from t union all select 0, (select n from n) || ' ' || (select count(*) // 2 from e) || ' 001'")
def adjacency_lines(spark, sf):
    from .sources.adjacency import adjacency_lines as lines

    return lines(g_clean(spark, sf))


@query("select true as same, false as differs")
def graph_equals(spark, sf):
    g = g_clean(spark, sf)
    return spark.range(1).select(F.lit(g.equals(T.transpose(T.transpose(g)))).alias("same"), F.lit(g.equals(T.transpose(g))).alias("differs"))


# --- statistics ---------------------------------------------------------------------------------------------------------


@query(f"with {E_PARTS}, h as (select cast(floor(src / cast(n as double) * 16.0) as int) as bin_src, cast(floor(dst / cast(n as double) * 16.0) as int) as bin_dst, n, count(*) as c from e, n group by all) select a.bin_src, b.bin_dst, round(coalesce(c * 16.0 / cast(n as double), 0.0), 9) as value from (select cast(unnest(range(16)) as int) as bin_src) a cross join (select cast(unnest(range(16)) as int) as bin_dst) b left join h using (bin_src, bin_dst)")
def heatmap_16(spark, sf):
    return _rounded(St.heat_map(g_parts(spark, sf), 16), 9)


@query(f"with {E_PARTS}, p as (select src, dst, count(*) as c from e where src <> dst group by src, dst), w as (select cast(sum(a.c * b.c) as bigint) as closed from p a join p b on a.dst = b.src and a.src <> b.dst semi join p c on c.src = a.src and c.dst = b.dst), t as (select cast(sum(d * (d - 1)) as bigint) as triples from (select count(*) as d from e group by src)) select closed, triples, round(closed / cast(triples as double), 9) as value from w, t")
def clustering(spark, sf):
    return _rounded(St.clustering(g_parts(spark, sf)), 9)


@query(f"with {E_PARTS} select round(sum(d * d) / cast(max(n) as double), 9) as value from (select count(*) as d from e group by dst), n")
def avg_nbr_in(spark, sf):
    return _rounded(St.avg_neighbour_degree(g_parts(spark, sf), "in"), 9)


@query(f"with {E_PARTS} select round(sum(d * d) / cast(max(n) as double), 9) as value from (select count(*) as d from e group by src), n")
def avg_nbr_out(spark, sf):
    return _rounded(St.avg_neighbour_degree(g_parts(spark, sf), "out"), 9)


@query(f"with {E_PARTS}, o as (select src, count(*) - 1 as o from e group by src), i as (select dst, count(*) - 1 as i from e group by dst), s as (select cast(sum(o * i) as bigint) as s_oi, cast(sum(o) as bigint) as s_o, cast(sum(i) as bigint) as s_i, cast(sum(o * o) as bigint) as s_oo, cast(sum(i * i) as bigint) as s_ii, cast(count(*) as double) as m from e join o using (src) join i using (dst)) select s_oi, s_o, s_i, s_oo, s_ii, round((m * s_oi - cast(s_o as double) * s_i) / sqrt((m * s_oo - cast(s_o as double) * s_o) * (m * s_ii - cast(s_i as double) * s_i) + 1), 9) as value from s")
def assortativity(spark, sf):
    return _rounded(St.assortativity(g_parts(spark, sf)), 9)


_ORDER = f"with {E_PARTS}, o as (select src, dst, row_number() over (order by src, dst) - 1 as eid from e)"


@query(_ORDER + ", l as (select src, dst, coalesce(lag(src) over (order by eid), 0) as ps, coalesce(lag(dst) over (order by eid), 0) as pd from o) select max(n) * max(n) // count(*) as packing, cast(sum(abs(dst - pd)) filter (ps = src) as bigint) // count(*) filter (ps = src) as vertex, cast(sum(abs(dst - pd)) as bigint) // count(*) as global, cast(sum(abs(src - dst)) as bigint) // count(*) as diagonal from l, n")
def stride_metrics(spark, sf):
    return St.stride(g_parts(spark, sf), segment=1 << 12)


def _cache_sql(compat: bool) -> str:
    marked = "(first >> (slot + 1)) & 1 = 1" if compat else "slot = first"
    return _ORDER + f""", c as (select eid, dst // 16 as line, cast(dst % 16 as int) as slot from o),
a as (select *, case when eid - lag(eid) over (partition by line order by eid) <= 60 then 0 else 1 end as miss from c),
b as (select *, sum(miss) over (partition by line order by eid) as life from a),
d as (select *, first_value(slot) over (partition by line, life order by eid) as first, row_number() over (partition by line, life, slot, miss order by eid) > 1 as again from b),
k as (select case when miss = 1 then 'miss' when {marked} or again then 'time' else 'local' end as k from d)
select count(*) filter (k = 'time') as time, count(*) filter (k = 'local') as local, count(*) filter (k = 'miss') as miss from k"""


query(_cache_sql(True), "cache_hits_compat")(lambda spark, sf: St.cache_hits(g_parts(spark, sf), window=60))
query(_cache_sql(False), "cache_hits_fixed")(lambda spark, sf: St.cache_hits(g_parts(spark, sf), window=60, compat=False))

# --- partitioning ---------------------------------------------------------------------------------------------------------

_PART = f"with {E_CLEAN}, {_DEG}, p as (select id, cast(id // ((n + 3) // 4) as int) as part from v, n), ix as (select id, part, row_number() over (partition by part order by id) - 1 as local_id from p)"
_CROSS = _PART + ", x as (select distinct dst as id, a.part from e join ix a on a.id = src join ix b on b.id = dst where a.part <> b.part), g as (select x.id, o.part as owner, o.local_id as owner_local, x.part, row_number() over (partition by x.part order by x.id) - 1 + (select count(*) from ix where ix.part = x.part) as ghost_local from x join ix o on o.id = x.id)"


def _index(spark, sf, parts=4):
    g = g_clean(spark, sf)
    return g, stored(P.part_index(P.block_parts(g, parts)), "index")


query(_PART + " select id, part from p", "part_block")(lambda spark, sf: P.block_parts(g_clean(spark, sf), 4))
query(_PART + " select * from ix", "part_index_rows")(lambda spark, sf: _index(spark, sf)[1])


@query(f"with {E_CLEAN}, {_DEG}, p as (select id, cast((id * 7) % 5 as int) as part from v) select id, part, row_number() over (partition by part order by id) - 1 as local_id from p")
def part_file(spark, sf):
    g = g_clean(spark, sf)
    return P.part_index(P.file_parts(g, spark.range(g.n).select("id", (F.col("id") * 7 % 5).alias("part"))))


@query()
def part_random(spark, sf):
    return P.random_parts(g_clean(spark, sf), 4, seed=3)


@query(_CROSS + " select id, part from x")
def cross_edges(spark, sf):
    return P.cross_pairs(*_index(spark, sf))


@query(_CROSS + " select * from g")
def ghosts(spark, sf):
    return P.ghosts(*_index(spark, sf))


@query(_CROSS + " select a.part, a.local_id as src, case when b.part = a.part then b.local_id else g.ghost_local end as dst, etag from e join ix a on a.id = src join ix b on b.id = dst left join g on g.id = dst and g.part = a.part")
def subgraph_edges(spark, sf):
    g, ix = _index(spark, sf)
    return P.subgraph_edges(g, ix, stored(P.ghosts(g, ix), "ghosts"))


@query(_CROSS + ", q as (select id, string_agg(part || ' ' || ghost_local, ' ' order by part) as t from g group by id) select ix.id, part || ' ' || local_id || coalesce(' ' || t, '') as line from ix left join q using (id)")
def part_index_lines(spark, sf):
    g, ix = _index(spark, sf)
    return P.index_lines(ix, P.ghosts(g, ix))


@query(_CROSS + " select owner_local, ghost_local, cast((owner << 16) | part as bigint) as tag from g")
def cross_graph_rows(spark, sf):
    return P.cross_graph(P.ghosts(*_index(spark, sf)))


@query(_CROSS + " select (select count(*) from x) as crossing, count(*) as edges, round((select count(*) from x) * 100.0 / count(*), 9) as percent from e")
def crossing_ratio(spark, sf):
    return _rounded(P.crossing_ratio(*_index(spark, sf)), 9)


@query(f"with {E_CLEAN} select src, dst from e")
def partition_reassembled(spark, sf):
    from .sources.partition_files import reassembled

    g, ix = _index(spark, sf)
    m = stored(P.ghosts(g, ix), "ghosts")
    return reassembled(P.subgraph_edges(g, ix, m), ix, m)


@query(_CROSS + " select g.part, g.ghost_local as local_id, coalesce(deg, 0) as value from g left join (select src as id, count(*) as deg from e group by src) using (id)")
def degree_sync_out(spark, sf):
    g, ix = _index(spark, sf)
    return P.sync_out(St.out_degree(g).withColumnRenamed("deg", "value"), P.ghosts(g, ix))


@query(f"with {E_CLEAN} select dst as id, count(*) as value from e group by dst")
def degree_sync_in(spark, sf):
    g, ix = _index(spark, sf)
    m = stored(P.ghosts(g, ix), "ghosts")
    partial = P.subgraph_edges(g, ix, m).groupBy("part", F.col("dst").alias("local_id")).agg(F.count("*").alias("value"))
    return P.sync_in(partial, ix, m)


_BLK = "select src, dst, cast((src // 32) % 4 as int) as brow, cast((dst // 32) % 4 as int) as bcol, (src // 32) // 4 * 32 + src % 32 as local_src, (dst // 32) // 4 * 32 + dst % 32 as local_dst from e"
query(f"with {E_PARTS} {_BLK}", "block_ids_b4")(lambda spark, sf: P.block_ids(g_parts(spark, sf), 4).drop("etag"))
query(f"with {E_PARTS}, b as ({_BLK}) select brow, bcol, count(*) as n from b group by all", "block_edge_counts")(lambda spark, sf: P.block_edge_counts(g_parts(spark, sf), 4))
query(f"with {E_PARTS} select src, dst from e", "block_round_trip")(lambda spark, sf: P.from_blocks(P.block_ids(g_parts(spark, sf), 4), 4))


@query("select event_id, cast((event_id % 100 << 16) | (user_id % 100) as bigint) as tag, cast(event_id % 100 as bigint) as owner, cast(user_id % 100 as bigint) as part, cast((user_id % 100 << 16) | (event_id % 100) as bigint) as turned from events")
def tag_encode_decode(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.encode_tag(F.col("event_id") % 100, F.col("user_id") % 100).alias("tag"))
    owner, part = S.decode_tag(F.col("tag"))
    return t.select("event_id", "tag", owner.alias("owner"), part.alias("part"), S.transpose_tag(F.col("tag")).alias("turned"))


@query("select event_id, case when user_id % 7 = 0 then 0 else cast(ceil(event_id / cast(user_id % 7 as double)) as bigint) end as up, event_type not in ('0', 'f', 'false', 'n', 'no') as flag from events")
def scalar_functions(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.select("event_id", S.ceil_div(F.col("event_id"), F.col("user_id") % 7).alias("up"), S.to_bool(F.col("event_type")).alias("flag"))


# --- PageRank ---------------------------------------------------------------------------------------------------------


def pagerank_sql(e: str, steps: int, tail: str = "select id, round(rank, 9) as rank from p{k}", d: float = 0.85) -> str:
    parts = [f"with {e}", _DEG, "g as (select src as id, count(*) as deg from e group by src)", "p0 as materialized (select v.id, coalesce(deg, 0) as deg, 1.0::double / n as rank from v left join g using (id), n)"]
    for k in range(steps):
        parts.append(f"s{k} as materialized (select dst as id, sum(rank / deg) as s from e join p{k} on p{k}.id = src group by dst), b{k} as materialized (select {d}::double * coalesce(sum(rank) filter (deg = 0), 0) / max(n) + {round(1 - d, 12)}::double / max(n) as b from p{k}, n), p{k + 1} as materialized (select p{k}.id, deg, {d}::double * coalesce(s, 0) + b as rank, rank as prev from p{k} left join s{k} using (id), b{k})")
    return ", ".join(parts) + " " + tail.format(k=steps)


def _ranks(r: PR.Result) -> DataFrame:
    return r.ranks.select("id", F.round("rank", 9).alias("rank"))


for _p in ("stp", "def", "rdx", "part"):
    query(pagerank_sql(E_CLEAN, 6), f"pagerank_fixed_{_p}")(lambda spark, sf, p=_p: _ranks(PR.pagerank(g_clean(spark, sf), p, steps=6)))
query(pagerank_sql(E_TRADE, 4), "pagerank_trade")(lambda spark, sf: _ranks(PR.pagerank(g_trade(spark, sf), steps=4)))
query(pagerank_sql(E_TRADE, 5, "select round(sum(rank), 9) as total, round(sum(rank) filter (deg = 0), 9) as dangling from p{k}"), "pagerank_dangling_mass")(
    lambda spark, sf: PR.pagerank(g_trade(spark, sf), steps=5).ranks.join(St.out_degree(g_trade(spark, sf)), "id").agg(F.round(F.sum("rank"), 9).alias("total"), F.round(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), 9).alias("dangling"))
)
query(pagerank_sql(E_CLEAN, 6, "select id, round(rank, 9) as rank from p{k} order by round(rank, 9) desc, id limit 10"), "pagerank_top10")(lambda spark, sf: _ranks(PR.pagerank(g_clean(spark, sf), steps=6)).orderBy(F.desc("rank"), "id").limit(10))


@query()
def pagerank_converged(spark, sf):
    """Until the L1 change of a step is at most 1e-6."""
    return _ranks(PR.pagerank(g_clean(spark, sf)))


@query("select true as ok, true as summed")
def pagerank_check(spark, sf):
    """Two plan shapes against each other."""
    g = g_clean(spark, sf)
    one = PR.check(PR.pagerank(g, "rdx", steps=2).ranks, PR.pagerank(g, "stp", steps=2).ranks)
    return one.select("ok", (F.abs(F.col("total") - 1) < 1e-9).alias("summed"))


@query(f"with {E_TRADE}, g as (select src, count(*) as d from e group by src), x as (select unnest(range((select n from n))) as id) select dst as id, round(sum(1.0::double / d * (src % 10)), 9) as y from e join g using (src) group by dst")
def pagerank_spmv(spark, sf):
    g = g_trade(spark, sf)
    x = spark.range(g.n).select("id", (F.col("id") % 10).cast("double").alias("x"))
    return _rounded(PR.spmv(PR.spmv_weights(g), x), 9)


_K = f"with {E_TRADE}, {_DEG}, d as (select src as id, count(*) as deg from e group by src), r as (select v.id, coalesce(deg, 0) as deg, 1.0::double / n as rank from v left join d using (id), n)"
for _k, _sql in {
    "tmp": "select id, round(rank / deg, 12) as tmp from r where deg > 0", "update": "select dst, round(sum(rank / deg), 12) as s from e join r on r.id = src group by dst",
    "base": "select round(sum(case when deg = 0 then rank else 0 end) * (0.85::double / max(n)) + 0.15::double / max(n), 12) as x from r, n", "asum": "select round(sum(rank), 12) as x from r",
    "dest": "select dst as id, round(sum(rank / deg) * 0.85::double + 0.15::double / max(n), 12) as x from e join r on r.id = src, n group by dst", "base_mapped": "select id, round(case when deg = 0 then rank else 0 end, 12) as x from r",
}.items():
    query(f"{_K} {_sql}", f"kernel_{_k}")(lambda spark, sf, k=_k: _rounded(PR.kernels(g_trade(spark, sf))[k], 12))


@query("with q as (select quantile_cont(value, [0.25, 0.5, 0.75]) as c from events) select event_id, len(list_filter(c, lambda x: value > x)) as bin from events, q")
def value_bins(spark, sf):
    return A.percentile_bins(spark.read.parquet(f"{sf}/events.parquet"), "value", 4).select("event_id", F.col("bin").cast("long").alias("bin"))


@query("select event_id, replace(event_type, 'c', 'K_') as t, ts is not null as there from events")
def replace_text(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.replace_text(F.col("event_type"), "c", "K_").alias("t"), F.col("ts").isNotNull().alias("there"))


# --- generators -------------------------------------------------------------------------------------------------------

_edges("gen_regular", lambda s, d: G.regular(s, 1000, 5, 3), "select v as src, ((v + k) * 3) % 1000 as dst from (select unnest(range(1000)) as v), (select unnest(range(5)) as k)")
_edges("gen_lattice", lambda s, d: G.lattice(s, 400, 800), "with e as (select v as src, (v + 1) % 400 as dst from (select unnest(range(400)) as v)) select src, dst from e union all select dst, src from e")
_edges("gen_lattice_2d", lambda s, d: G.lattice(s, 400, 3200), "with v as (select unnest(range(400)) as v), e as (select v as src, v - v % 20 + (v % 20 + 1) % 20 as dst from v union all select v, (v // 20 + 1) % 20 * 20 + v % 20 from v) select src, dst from e union all select dst, src from e")
_edges("gen_star", lambda s, d: G.star(s, 500, 1000), "select v as src, 0 as dst from (select unnest(range(1, 500)) as v) union all select 0, v from (select unnest(range(1, 500)) as v)")
_edges("gen_tree", lambda s, d: G.tree(s, 1000, 3000), "select v as src, (v - 1) // 3 as dst from (select unnest(range(1, 1000)) as v)")
_edges("gen_full", lambda s, d: G.full(s, 10, 900), "select a as src, b as dst from (select unnest(range(30)) as a), (select unnest(range(30)) as b) where a <> b")
for _name, _make in (
    ("gen_random", lambda s: G.erdos_renyi(s, 2000, 20000)), ("gen_blocked_random", lambda s: G.blocked_random(s, 2, 1000, 8000)), ("gen_kronecker", lambda s: G.rmat(s, 1024, 8192)), ("gen_geometric", lambda s: G.geometric(s, 1000, 5000)),
    ("gen_barabasi", lambda s: G.barabasi(s, 500, 1500)), ("gen_forest_fire", lambda s: G.forest_fire(s, 500, 500)), ("gen_powerlaw", lambda s: G.static_powerlaw(s, 2000, 10000)),
):
    query(None, _name)(lambda spark, sf, make=_make: make(spark).edges)

# --- tokens and logs ------------------------------------------------------------------------------------------------------

_TOK = r"with w as (select doc_id, unnest(regexp_extract_all(text, '[^ \f\n\r\t\v]+')) as token, generate_subscripts(regexp_extract_all(text, '[^ \f\n\r\t\v]+'), 1) as pos from documents where text is not null and substr(text, 1, 1) not in ('#', '%')), f as (select token, min(doc_id * 10000000 + pos) as place from w group by token), t as (select token, row_number() over (order by place) - 1 as id from f)"


def _lines(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("line"), F.col("text").alias("value"))


@query(_TOK + " select token, id from t")
def strtoidx_tokens(spark, sf):
    return Tok.token_ids(_lines(spark, sf))


@query(_TOK + " select doc_id as line, string_agg(cast(t.id as varchar), ' ' order by pos) as ids from w join t using (token) group by doc_id")
def strtoidx_lines(spark, sf):
    out = Tok.strtoidx(_lines(spark, sf).where(~F.substring("value", 1, 1).isin("#", "%")))
    return out.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select("line", F.trim(F.regexp_replace("value", r"\s+", " ")).alias("ids"))


#: literal log rows: dataset, solver, blocks, vertices, edges, iterations and times
LOG = [
    ("er_a", "pr_bcsc_omp_stp", 1, 1000, 8000, 10, 40.0), ("er_a", "pr_bcsc_omp_stp", 1, 1000, 8000, 10, 44.0), ("er_a", "pr_bcsc_omp_stp", 16, 1000, 8000, 10, 20.0), ("er_a", "pr_bcsr_cud_dyn", 1, 1000, 8000, 10, 5.0),
    ("er_a", "pr_bcsr_cud_dyn", 16, 1000, 8000, 10, 4.0), ("pl_b", "pr_bcsc_omp_stp", 1, 2000, 50000, 20, 300.0), ("pl_b", "pr_bcsc_omp_stp", 16, 2000, 50000, 20, 150.0), ("pl_b", "pr_csc_mkl_lib", 1, 2000, 50000, 20, 410.0), ("pl_c", "pr_bcsr_cud_dyn", 1, 4000, 64000, 20, 16.0),
]
_ROWS = ", ".join(f"('{a}', '{b}', {c}, {d}, {e}, {f}, {t}, 1.0, 2.0, 3.0, 4.0, 5.0)" for a, b, c, d, e, f, t in LOG)
_LOG = f"with log(DATASET, SOLVER, B, V, E, it, time_ms, init_ms, base_us, rank_us, diff_us, trans_ms) as (select col0, col1, cast(col2 as int), cast(col3 as bigint), cast(col4 as bigint), cast(col5 as int), cast(col6 as double), 1.0, 2.0, 3.0, 4.0, 5.0 from (values {_ROWS})), m as (select DATASET, B, it, SOLVER, max(V) as V, max(E) as E, avg(time_ms) as time_ms from log group by all), x as (select *, E / 1e6 / (time_ms / it) as EPS, V / 1e6 / (time_ms / it) as PS from m)"


def _log(spark):
    rows = spark.createDataFrame([(a, b, c, d, e, f, t, 1.0, 2.0, 3.0, 4.0, 5.0) for a, b, c, d, e, f, t in LOG], A.BENCH_SCHEMA)
    return A.with_metrics(A.with_names(A.clean(rows)))


@query(_LOG + r" select DATASET, SOLVER, B, it, round(time_ms, 6) as time_ms, round(EPS, 9) as EPS, round(PS, 9) as PS, round(E / cast(V as double), 9) as mean_degree, regexp_extract(SOLVER, 'pr_[a-z]+_([a-z]+)_', 1) as FRAMEWORK, regexp_extract(SOLVER, '_([a-z]+)$', 1) as METHOD, case when SOLVER like '%csc_%' then 'pull' else 'push' end as FLOW from x")
def log_metrics(spark, sf):
    return _log(spark).select("DATASET", "SOLVER", "B", "it", F.round("time_ms", 6).alias("time_ms"), F.round("EPS", 9).alias("EPS"), F.round("PS", 9).alias("PS"), F.round("mean_degree", 9).alias("mean_degree"), "FRAMEWORK", "METHOD", "FLOW")


@query(_LOG + " select SOLVER, round(max(EPS), 9) as EPS from x group by SOLVER")
def log_best_per_kernel(spark, sf):
    return A.best(_log(spark), ["SOLVER"]).select("SOLVER", F.round("EPS", 9).alias("EPS"))


@query(_LOG + " select DATASET, SOLVER, B, round(x.EPS / b.EPS, 9) as ratio from x join (select DATASET, SOLVER, avg(EPS) as EPS from x where B = 1 group by all) b using (DATASET, SOLVER)")
def log_baseline_ratio(spark, sf):
    return A.baseline_ratio(_log(spark)).select("DATASET", "SOLVER", "B", F.round("ratio", 9).alias("ratio"))


@query(_LOG + " select SOLVER, round(avg(EPS), 9) as mean, round(stddev_samp(EPS), 9) as std from x where regexp_matches(SOLVER, 'omp|cud') group by SOLVER")
def log_spread(spark, sf):
    return _rounded(A.spread(_log(spark).where(F.col("SOLVER").rlike("omp|cud")), ["SOLVER"]), 9)


@query(_LOG + ", s as (select distinct split_part(DATASET, '_', 1) as g, DATASET from x) select DATASET, SOLVER, B, split_part(DATASET, '_', 1) || ' (' || (select count(*) from s where g = split_part(x.DATASET, '_', 1)) || ')' as LABEL from x")
def log_group_label(spark, sf):
    return A.with_group_size(_log(spark)).select("DATASET", "SOLVER", "B", "LABEL")


@query(_LOG + ", st(DATASET, clustering) as (values ('er_a', 0.25), ('er_a', 0.35), ('pl_b', 0.5)) select x.DATASET, SOLVER, B, round(c, 9) as clustering from x left join (select DATASET, cast(avg(clustering) as double) as c from st group by DATASET) using (DATASET)")
def log_stats_join(spark, sf):
    stats = spark.createDataFrame([("er_a", 0.25), ("er_a", 0.35), ("pl_b", 0.5)], "DATASET string, clustering double")
    return A.with_stats(_log(spark), stats).select("DATASET", "SOLVER", "B", F.round("clustering", 9).alias("clustering"))


@query(f"with h as ({ORACLE['deg_hist_dense']}) select deg, round(sum(n * deg) over (order by deg) / cast(sum(n * deg) over () as double), 9) as share from h")
def lorenz_curve(spark, sf):
    return _rounded(A.lorenz(deg_hist_dense(spark, sf).withColumn("w", F.col("n") * F.col("deg")), "w"), 9)


@query(f"with h as ({ORACLE['deg_hist']}), c as (select deg, sum(n * deg) over (order by deg) / cast(sum(n * deg) over () as double) as share from h) select min(deg) as half from c where share >= 0.5")
def lorenz_half(spark, sf):
    return A.half_point(A.lorenz(deg_hist(spark, sf).withColumn("w", F.col("n") * F.col("deg")), "w"))


@query(f"with h as ({ORACLE['deg_hist']}), s as (select sum(w) as w, sum(w * a) as wx, sum(w * b) as wy, sum(w * a * a) as wxx, sum(w * a * b) as wxy from (select log2(deg + 0.5::double) as a, log2(n + 1.0::double) as b, log2(n + 1.0::double) ** 2 as w from h)), f as (select *, (w * wxy - wx * wy) / (w * wxx - wx * wx) as slope from s) select round(slope, 6) as slope, round((wy - slope * wx) / w, 6) as intercept from f")
def loglog_fit(spark, sf):
    return _rounded(A.loglog_fit(deg_hist(spark, sf)), 6)


@query("with q as (select quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.75) as q75 from events) select round(q25, 6) as q25, round(q75, 6) as q75, round(q25 - 3 * (q75 - q25), 6) as lo, round(q75 + 3 * (q75 - q25), 6) as hi from q")
def value_fences(spark, sf):
    return _rounded(A.fences(spark.read.parquet(f"{sf}/events.parquet"), "value"))


@query("with s as (select sum(l_quantity * l_extendedprice) / sum(l_quantity) as m from lineitem) select round(m, 4) as mean, round(sqrt(sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m)) / sum(l_quantity)), 4) as std from lineitem, s group by m")
def weighted_moments(spark, sf):
    return _rounded(A.weighted(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice", "l_quantity"), 4)


@query()
def normality_test(spark, sf):
    return A.normality(spark.read.parquet(f"{sf}/events.parquet"), "value")
