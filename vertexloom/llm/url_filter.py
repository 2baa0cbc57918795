"""URL filter with redirect equivalence, in DataFrame operations only.

A rule (host, path, verdict) fits its host and all subdomains, for paths that start with its own;
the longest fitting rule decides a page.  Redirects and canonical links join urls into classes of
aliases (distributed connected components); a page that no rule fits is blocked if its class has
a blocked member and no explicitly allowed one (allow takes precedence), else allowed.  A page's
own rule always stands.

Defined cases: null url or one without ``://``: host and path empty, no rule, allowed; null html:
no links; a relative target on a page whose url has no scheme and host, or a target such as
``about:blank`` that names no host: no link; urls that differ in their fragment alone are one page;
repeated rows come back repeatedly; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, components, stored

#: rules are broadcast up to so many rows (under 200 bytes each)
BROADCAST_RULES = 50_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: an attribute's value in double or single quotes, or bare
CANONICAL = r"""(?i)<link\s[^>]*?rel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?i)<meta\s[^>]*?http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TARGET = r"""(?i);\s*url\s*=\s*['"]?([^"'>\s]+)"""
BASE = r"""(?i)<base\s[^>]*>"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
SITE = SCHEME + "//[^/?#]*"


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def without_fragment(url: F.Column) -> F.Column:
    return F.regexp_extract(url, r"^[^#]*", 0)


def without_dots(path: F.Column) -> F.Column:
    """A path that starts with ``/``, its ``.`` and ``..`` segments taken out."""
    parts = F.split(path, "/")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def resolved(to: F.Column, base: F.Column) -> F.Column:
    """The url without fragment that ``to`` names on a page at ``base`` (RFC 3986, 5.2); null if it names no host.

    Absolute targets stand as they are, as the pages' own urls do."""
    ref = without_fragment(F.btrim(to, F.lit(" \t\n\r\f")))
    site, base_path, base_query = F.regexp_extract(base, SITE, 0), F.regexp_extract(base, SITE + "([^?#]*)", 1), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    path, query = F.regexp_extract(ref, r"^[^?]*", 0), F.regexp_extract(ref, r"(?s)\?.*", 0)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_extract(base_path, r"(?s)^.*/", 0))
    return (
        F.when(ref.rlike(SCHEME + "//"), ref).when(ref.rlike(SCHEME) | (site == ""), F.lit(None))
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 0), ref))
        .when(path == "", F.concat(site, base_path, F.when(query == "", base_query).otherwise(query)))
        .otherwise(F.concat(site, without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), query))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst: a page's url and the target of its canonical link or its refresh redirect, without fragments.

    Targets are resolved against the page's ``<base href>``, if it has one, or its own url."""
    href = lambda tag: F.concat(*(F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)))
    canonical, refresh = href(F.regexp_extract("html", CANONICAL, 0)), F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1)
    base = href(F.regexp_extract("html", BASE, 0))
    made = (
        pages.where("url is not null and html is not null").where(F.lower("html").rlike("canonical|http-equiv"))
        .select("url", base.alias("base"), F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
        .select("url", "to", F.when(F.col("base") != "", resolved(F.col("base"), F.col("url"))).alias("base"))
        .select(without_fragment(F.col("url")).alias("src"), resolved(F.col("to"), F.coalesce("base", "url")).alias("dst"))
    )
    return made.where("dst <> '' and dst <> src")


def plain_form(url: F.Column) -> F.Column:
    """The canonical spelling of a web url: https, host in lower case without default port, no closing
    slashes, no ``utm_`` parameters, no fragment; null for other schemes."""
    whole = without_fragment(url)
    rest = F.substring(whole, F.instr(whole, "://") + F.lit(3), F.length(whole))
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, r"^[^/?]*", 0), UPPER, LOWER), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_")), "&")
    return F.when(whole.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://"), F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def spelling_edges(pages: DataFrame) -> DataFrame:
    """src, dst: a page's url and its canonical spelling, where they differ.

    A page is implicitly canonical to that spelling, so that its variants (http and https, with and
    without closing slash or tracking parameters) form one class."""
    made = pages.select(without_fragment(F.col("url")).alias("src"), plain_form(F.col("url")).alias("dst"))
    return made.where("src is not null and dst is not null and src <> dst")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page columns, host, path, rule and rule_verdict (null where none fits); page columns of those names are replaced.

    Every page meets only rules whose host is a suffix of its own; rules beyond the broadcast
    bound meet the pages in a salted join, so that a hot suffix spreads over SALTS tasks."""
    pages = pages.drop("host", "path", "rule", "rule_verdict")
    host, path = url_parts(F.col("url"))
    named = pages.withColumns({"host": host, "path": path, "__key": F.monotonically_increasing_id()})
    r = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict").where("r_host is not null and r_host <> ''")
    if broadcast_if(r, BROADCAST_RULES) is r:
        named = stored(named, "pages")  # the key must not change between two reads
        labels = F.split("host", r"\.")
        suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        left = named.where("host <> ''").select("__key", "path", F.explode(suffix).alias("r_host"), F.pmod(F.col("__key"), F.lit(SALTS)).alias("salt"))
        right = r.withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
        fit = left.join(right, ["r_host", "salt"]).where(F.col("path").startswith(F.col("r_path")))
        best = fit.groupBy("__key").agg(F.max(F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("verdict") == "allow", "r_host", "r_path", "verdict")).alias("b"))
        out = named.join(best, "__key", "left").select(*pages.columns, "host", "path", F.concat("b.r_host", "b.r_path").alias("rule"), F.col("b.verdict").alias("rule_verdict"))
        return out
    few = r.agg(F.collect_list(F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("verdict") == "allow").alias("c"), "r_host", "r_path", "verdict")).alias("rules"))
    fits_ = F.filter("rules", lambda x: ((F.col("host") == x["r_host"]) | F.col("host").endswith(F.concat(F.lit("."), x["r_host"]))) & F.col("path").startswith(x["r_path"]))
    best = named.drop("__key").join(F.broadcast(few)).withColumn("b", F.array_max(fits_))
    return best.select(*pages.columns, "host", "path", F.concat("b.r_host", "b.r_path").alias("rule"), F.col("b.verdict").alias("rule_verdict"))


def url_filter(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and component (null outside any link)."""
    edges = link_edges(pages).unionAll(spelling_edges(pages)) if edges is None else edges.select(*(without_fragment(F.col(c)).alias(c) for c in ("src", "dst")))
    comp = stored(components(edges), "components")
    judged = match_rules(pages.select("page_id", "url"), rules)
    if comp.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("component"))
    # verdicts of the classes also count link targets that are no pages themselves
    nodes = match_rules(comp.withColumnRenamed("node", "url"), rules)
    classes = nodes.groupBy("component").agg(F.max((F.col("rule_verdict") == "block").cast("int")).alias("blocked"), F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allowed"))
    of_node = comp.join(classes, "component").select("node", "component", F.when((F.col("blocked") == 1) & (F.coalesce("allowed", F.lit(0)) == 0), F.lit("block")).alias("by_class"))
    return judged.join(of_node, without_fragment(F.col("url")) == F.col("node"), "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "by_class", F.lit(default)).alias("verdict"), "component")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows, built without Python workers."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("select * from values " + ", ".join(f"({q(h)}, {q(p)}, {q(v)})" for h, p, v in rules) + " as t(host, path, verdict)")
