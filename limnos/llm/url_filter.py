"""URL filters with redirect equivalence (DataFrame functions only).

A rule is (host, path, verdict): it fits the host and its subdomains where the url's path starts with the rule's; of
several the longest wins. Redirect and canonical-link edges tie urls into components: a url that no rule
names is blocked if a rule blocks any url of its component, whether or not that url is a page of the table. A url
that an explicit allow rule names stays allowed whatever its component holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that one expression tests, as part of the plan; more of them, or a table of rules, are joined.
INLINE_RULES = 500

Rules = list[tuple[str, str, str]] | DataFrame

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_COMMENT = r"(?s)<!--.*?(?:-->|$)"
_LINK, _META, _BASE = r"(?i)<link\b[^<>]*>", r"(?i)<meta\b[^<>]*>", r"(?i)<base\b[^<>]*>"
#: Attributes stand in any order; rel is a list of words.
_CANONICAL = r"""(?i)[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s>/])"""
_IS_REFRESH = r"""(?i)[\s"'/]http-equiv\s*=\s*["']?\s*refresh["'\s>/]"""
_HREF = r"""(?i)[\s"'/]href\s*=\s*(?:"\s*([^"]*)"|'\s*([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?i)[\s"';0-9,]url\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _HOST, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def decide(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule (host and path joined) and verdict of the longest rule that fits; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(urls: DataFrame, rules: Rules, host: str, path: str, out: str) -> DataFrame:
    """urls with `decide`'s struct in column out. A table of rules has host, path and verdict; it is met by equal keys alone: a distinct
    url's host suffixes, and its path cut to each length that rules of that suffix have."""
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        return urls.withColumn(out, decide(F.col(host), F.col(path), rules))
    if isinstance(rules, list):
        rules = urls.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    lengths = rules.select("host", F.length("path").alias("n")).distinct().groupBy("host").agg(F.collect_list("n").alias("lengths"))
    each = urls.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    parts = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = each.select("h", "p", F.explode(suffixes).alias("host")).join(lengths, "host")
    keys = keys.select("h", "p", "host", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("p"))
    met = keys.select("h", "p", "host", F.substring(F.col("p"), F.lit(1), F.col("n")).alias("path")).join(rules, ["host", "path"])
    found = F.struct(F.concat("host", "path").alias("rule"), "verdict")
    best = met.groupBy("h", "p").agg(F.max_by(found, F.struct(F.length(F.concat("host", "path")), "host", "verdict")).alias(out))
    best = best.withColumnsRenamed({"h": host, "p": path})
    return urls.join(best, [host, path], "left").select(*urls.columns, out)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it: else the plan repeats it, and its code grows beyond what the JVM compiles."""
    return F.get(F.transform(F.array(value), use), 0)


def _straight(path: Column) -> Column:
    """A path without `.` and `..` segments; `/` for an empty one."""
    parts = F.split(path, "/")

    def walk(p: Column) -> Column:
        way = F.aggregate(F.slice(p, 2, F.size(p)), F.lit(""), lambda at, x: F.when(x == "..", F.regexp_replace(at, "/[^/]*$", "")).when(x == ".", at).otherwise(F.concat(at, F.lit("/"), x)))
        return F.concat(way, F.when((F.size(p) == 1) | F.element_at(p, -1).isin(".", ".."), "/").otherwise(""))

    return _bound(parts, walk)


def node(url: Column) -> Column:
    """A url's name in the graph: without its fragment and its scheme's own port, the scheme and host in lower case, the path without dot segments; null for null or without ://."""

    def named(plain: Column) -> Column:
        head = F.translate(F.regexp_extract(plain, r"(?s)^(.*?://[^/?]*)", 1), UPPER, LOWER)
        rest = F.regexp_extract(plain, r"(?s)^.*?://[^/?]*(.*)$", 1)
        told = lambda h: F.regexp_replace(F.regexp_replace(h, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
        return _bound(head, lambda h: F.when(h != "", F.concat(told(h), _straight(F.regexp_extract(rest, r"(?s)^([^?]*)", 1)), F.regexp_extract(rest, r"(?s)^[^?]*(.*)$", 1))))

    return _bound(F.regexp_extract(url, r"(?s)^([^#]*)", 1), named)


def resolved(to: Column, base: Column) -> Column:
    """The url that a reference names, seen from the url base; its dot segments stay for `node`."""
    bare = F.regexp_extract(base, r"(?s)^([^?]*)", 1)

    def absolute(t: Column, origin: Column) -> Column:
        place = F.regexp_extract(bare, r"(?s)^(.*?://.*/)", 1)
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), t))
            .when(t.startswith("/"), F.concat(origin, t))
            .when(t.startswith("#") | (t == ""), base)
            .when(t.startswith("?"), F.concat(bare, t))
            .otherwise(F.concat(F.when(F.length(place) > F.length(origin), place).otherwise(F.concat(origin, F.lit("/"))), t))
        )

    return _bound(to, lambda t: _bound(F.regexp_extract(base, r"(?s)^(.*?://[^/?]*)", 1), lambda origin: absolute(t, origin)))


def _value(tag: Column, pattern: str, groups: int) -> Column:
    return F.trim(F.replace(F.concat(*(F.regexp_extract(tag, pattern, k + 1) for k in range(groups))), F.lit("&amp;"), F.lit("&")))


def html_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: the canonical links and the refresh redirects of each page, relative targets resolved against its first base or else its url. What stands in comments is none."""
    text = F.regexp_replace(F.coalesce(F.col(html).cast("string"), F.lit("")), _COMMENT, " ")

    def read(t: Column) -> Column:
        links = F.transform(F.filter(F.regexp_extract_all(t, F.lit(_LINK), F.lit(0)), lambda x: x.rlike(_CANONICAL)), lambda x: _value(x, _HREF, 3))
        metas = F.transform(F.filter(F.regexp_extract_all(t, F.lit(_META), F.lit(0)), lambda x: x.rlike(_IS_REFRESH)), lambda x: _value(x, _REFRESH, 1))
        bases = F.filter(F.transform(F.regexp_extract_all(t, F.lit(_BASE), F.lit(0)), lambda x: _value(x, _HREF, 3)), lambda x: x != "")
        return F.struct(F.filter(F.concat(links, metas), lambda x: x != "").alias("to"), F.get(bases, 0).alias("base"))

    found = pages.select(node(F.col(url)).alias("src"), _bound(text, read).alias("_t")).where("src is not null and size(_t.to) > 0")
    based = found.select("src", "_t.base", F.explode("_t.to").alias("to"))
    at = F.when(F.col("base").isNull(), F.col("src")).otherwise(F.coalesce(node(resolved(F.col("base"), F.col("src"))), F.col("src")))
    return based.select("src", _bound(at, lambda b: node(resolved(F.col("to"), b))).alias("dst"))


def filter_urls(pages: DataFrame, rules: Rules, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html", default: str = "allow") -> DataFrame:
    """pages with `host`, `path`, `rule` and `verdict` added (clashing columns are replaced).

    rules: (host, path, verdict) tuples, or a table of them of any size. redirects: src and dst urls, besides those that the pages' html names. Null urls and urls without :// have an empty
    host and path, no rule and the default verdict. Repeated pages get equal verdicts; an empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    n = unused(pages, "_node", "_rule", "_blocked")
    name, rule, mark = n["_node"], n["_rule"], n["_blocked"]
    parts = [t for t in (html_edges(pages, url, html) if html else None, redirects.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")) if redirects is not None else None) if t is not None]
    named = pages.select(*kept, host(F.col(url).cast("string")).alias("host"), path(F.col(url).cast("string")).alias("path"), node(F.col(url).cast("string")).alias(name))
    named = judged(named, rules, "host", "path", rule)
    blocked = F.lit(False)
    if parts:
        edges = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        edges = materialize(edges.where("src is not null and dst is not null and src != dst").distinct(), "url-edges")
        if edges.limit(1).count():
            roots = materialize(components(edges, "src", "dst"), "url-roots")
            nodes = judged(roots.select("root", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), rules, "host", "path", "rule")
            bad = nodes.where("rule.verdict = 'block'").select("root").distinct()
            aliases = roots.join(bad, "root", "left_semi").select(F.col("node").alias(name), F.lit(True).alias(mark))
            named = named.join(aliases, name, "left")
            blocked = F.coalesce(F.col(mark), F.lit(False))
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(blocked, F.lit("block")), F.lit(default))
    return named.select(*kept, "host", "path", F.col(f"{rule}.rule").alias("rule"), verdict.alias("verdict"))
