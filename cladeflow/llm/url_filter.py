"""URL filters that see through redirects and canonical links.

Rules decide what they fit. Pages that no rule fits are decided by what they are aliases of: pages and
the targets of their redirects and canonical links are joined into connected components, and a block
anywhere in a component holds for all of it, except for what a rule allows explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import cut, within
from cladeflow.llm.graph import components

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link tag that names the canonical address, and a meta tag that redirects.
CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
#: Rules that are looked up row by row at most, and parts in which more are joined.
FEW_RULES, SALTS = 1000, 32


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a page: its address without scheme and fragment; null if it has no host."""
    query = F.coalesce(F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), query))


def resolve(link: Column, url: Column) -> Column:
    """A link as a whole address, seen from the page ``url``."""
    scheme, at = F.substring_index(url, "://", 1), F.concat(F.substring_index(url, "://", 1), F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "^(.*/)", 1)
    return (
        F.when((link == "") | link.isNull(), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(at, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("#") | link.startswith("?"), None)
        .otherwise(F.concat(at, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def suffixes(host: Column) -> Column:
    """A host and all that it is a subdomain of."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def fits_of(rules: list, host: Column) -> Column:
    """The rules (rows of host, path, verdict) for a host and for what it is under, looked up in each row."""
    by: dict[str, list[Column]] = {}
    for r in rules:
        if None not in (r["host"], r["path"], r["verdict"]):
            one = F.struct(F.lit(len(r["host"] + r["path"])).alias("length"), F.lit(r["host"] + r["path"]).alias("rule"), F.lit(r["path"]).alias("path"), F.lit(r["verdict"]).alias("verdict"))
            by.setdefault(r["host"], []).append(one)
    if not by:
        return F.lit(None).cast("array<struct<length: int, rule: string, path: string, verdict: string>>")
    known = F.create_map(*[x for name, some in by.items() for x in (F.lit(name), F.array(*some))])
    return F.flatten(F.filter(F.transform(suffixes(host), lambda s: known[s]), lambda x: x.isNotNull()))


def with_fits(x: DataFrame, rules: DataFrame) -> DataFrame:
    """``x`` (host and more) with fits: the rules for its host and for what that is under.

    Up to ``FEW_RULES`` are looked up row by row. More are joined with the distinct hosts, and the hosts
    with the rows in salted parts, as a common host's rows shouldn't meet in one task.
    """
    few = rules.limit(FEW_RULES + 1).collect()
    if len(few) <= FEW_RULES:
        return x.withColumn("fits", fits_of(few, F.col("host")))
    named = rules.select(F.col("host").alias("suffix"), F.struct(F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("fit"))
    found = x.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("suffix")).join(within(named, 100_000), "suffix")
    fits = found.groupBy("host").agg(F.collect_set("fit").alias("fits")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = x.withColumn("salt", F.pmod(F.xxhash64("node", "path"), F.lit(SALTS)).cast("int"))
    return salted.join(fits, ["host", "salt"], "left").drop("salt")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each page: host, path, rule (the longest that fits, else null), verdict and component.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all subdomains where the
    page's path starts with the rule's; of rules of equal length the greater in code-point order
    wins. A page that no rule fits is blocked if a rule blocks any page or target that redirects and
    canonical links join it with, and allowed otherwise; an explicit allow takes precedence for the
    page that it fits, and doesn't lift a block from the others.

    Rules are looked up row by row, without a shuffle. Links are found by components(); without any,
    nothing is iterated.

    Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
    links with nothing, so that it is allowed; null html has no links; ids may be null and rows may
    repeat; an empty table stays empty; other columns are not returned. ``component`` is the smallest
    address in the page's component, null where it has no links.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    html = F.col(html_col).cast("string")
    targets = F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL_TAG, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract(html, REFRESH_TAG, 0), REFRESH_URL, 1),
    )
    marked = pages.filter(html.rlike("(?i)canonical|http-equiv")).select(url.alias("url"), F.explode(targets).alias("link"))
    links = marked.select(F.col("url"), resolve(F.col("link"), F.col("url")).alias("to")).filter("to IS NOT NULL")
    links = cut(links.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"), host_of(F.col("to")).alias("to_host"), path_of(F.col("to")).alias("to_path")))
    linked = not links.isEmpty()

    def decided(x: DataFrame) -> DataFrame:
        best = F.array_max(F.filter("fits", lambda r: F.col("path").startswith(r["path"])))
        return with_fits(x, rules).withColumn("best", best)

    pages_by_rule = decided(parsed)
    if not linked:
        said = F.coalesce(F.col("best")["verdict"], F.lit("allow"))
        return pages_by_rule.select(id_col, "host", "path", F.col("best")["rule"].alias("rule"), said.alias("verdict"), F.lit(None).cast("string").alias("component"))
    of = components(links.select("a", "b"))
    ends = decided(links.select(F.col("b").alias("node"), F.col("to_host").alias("host"), F.col("to_path").alias("path")))
    blocked = pages_by_rule.select("node", "best").union(ends.select("node", "best")).filter(F.col("best")["verdict"] == "block").select("node").distinct()
    bad = of.join(blocked, "node").select("component").distinct().withColumn("bad", F.lit(True))
    alias = of.join(bad, "component", "left").select("node", "component", "bad")
    joined = pages_by_rule.join(alias, "node", "left")
    said = F.coalesce(F.col("best")["verdict"], F.when(F.col("bad"), F.lit("block")), F.lit("allow"))
    return joined.select(id_col, "host", "path", F.col("best")["rule"].alias("rule"), said.alias("verdict"), "component")
