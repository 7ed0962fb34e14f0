"""URL filters with redirect equivalence.

Every url is judged by the rules on its host and path; the longest fitting rule wins. Pages also name other
addresses of themselves: <link rel="canonical">, <meta http-equiv="refresh"> and og:url. These edges,
between urls without scheme, fragment and tracking parameters, give classes of equivalent urls by
distributed connected components. A url without a rule of its own takes its class's decision: allow if any
url of the class is explicitly allowed, else block if any is blocked, else allow. Urls that are only named, not
stored, count as members of their class.

Only pages with edges enter the components; the rest are judged in the scan. Edges are plain rows, so a url
that a third of all pages redirect to is a hub of the components, not a hot group.

Cases: a null url, or one without ://, has an empty host and path, no rule and no edges; a null html has no
edges; very long urls and pages are handled whole, in their rows; relative targets are read against the page's host; rules of equal
length: the one listed first; rows that repeat each get their row; ids play no
part and may be null or of any type; an empty table stays empty; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Verdict, host, path of the rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.coalesce(common.ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null without one); equal lengths: the one listed first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), -rules.index(r))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def address(url: Column) -> Column:
    """What names a page: the url without scheme, fragment, tracking parameters and a last slash; null without a host."""
    host, path = host_path(url)
    query = F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), rf"(?i)(^|&)({TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    bare = F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", bare)


def unescaped(text: Column) -> Column:
    """text with numeric character references and those of HTML's own marks decoded, once; others stay."""
    one = r"&(#0*[1-9][0-9]{0,6}|#[xX]0*[1-9a-fA-F][0-9a-fA-F]{0,5}|(?:amp|AMP|lt|LT|gt|GT|quot|QUOT|apos));"
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def mark(e: Column) -> Column:
        number = F.when(F.lower(e).startswith("#x"), F.conv(F.substr(e, F.lit(3)), 16, 10)).otherwise(F.substr(e, F.lit(2))).try_cast("long")
        whole = F.startswith(e, F.lit("#")) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        out = F.when(whole, F.decode(F.unhex(F.lpad(F.hex(F.when(whole, number)), 8, "0")), "UTF-32"))
        for name, char in named.items():
            out = out.when(F.lower(e) == name, F.lit(char))
        return out.otherwise(F.concat(F.lit("&"), e, F.lit(";")))

    marks = F.concat(F.transform(F.regexp_extract_all(text, F.lit(one), 1), mark), F.array(F.lit("")))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.zip_with(F.split(text, one), marks, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def targets(html: Column) -> Column:
    """Addresses that a page gives for itself, without HTML's escapes: canonical link, refresh redirect, og:url."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*\bcanonical\b[^>]*>|<meta\b[^>]*(?:http-equiv\s*=\s*[\"']?refresh|og:url)[^>]*>)"), 1)
    value = lambda t: F.coalesce(
        F.nullif(F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"(?is)\burl\s*=\s*['\"]?((?:&#?\w+;|[^\"'\s>;])+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")),
    )
    return F.transform(F.filter(F.transform(tags, value), lambda t: t.isNotNull()), unescaped)


def absolute(target: Column, url: Column) -> Column:
    scheme = F.regexp_extract(url, r"^([^:]*)://", 1)
    host, path = host_path(url)
    base = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(F.locate("://", target) > 0, target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(base, target))
        .otherwise(F.concat(base, F.regexp_replace(path, "[^/]*$", ""), F.when(F.startswith(path, F.lit("/")), "").otherwise("/"), target))
    )


@common.owned
def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("own"))
    linked = pages.filter(F.col("html").rlike("(?i)canonical|http-equiv|og:url") & (F.locate("://", "url") > 0))
    linked = linked.select("url", F.explode(targets(F.col("html"))).alias("target"))
    linked = linked.select("url", absolute(F.col("target"), F.col("url")).alias("target"))
    edges = common.staged(linked.select(address(F.col("url")).alias("u"), address(F.col("target")).alias("v"), "target").distinct(), "links")
    classes = common.staged(components(edges.filter("u is not null and v is not null and u <> v")), "classes")

    def decided(url: Column) -> Column:
        return rule_of(*host_path(url), rules)[1]

    # rules bear on full urls, classes on addresses: a class's decisions are those of all urls that carry its addresses
    members = pages.select(address(F.col("url")).alias("node"), decided(F.col("url")).alias("verdict")).union(
        edges.select("v", decided(F.col("target")))
    ).filter("verdict is not null and node is not null")
    marks = classes.hint("merge").join(members.groupBy("node").agg(F.max(F.col("verdict") == "allow").alias("a"), F.max(F.col("verdict") == "block").alias("b")), "node")
    marks = marks.groupBy("label").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    found = common.staged(classes.join(marks.hint("merge"), "label").filter("b and not a").select("node"), "blocked")
    rows = rows.withColumn("node", F.when(F.col("own").isNull(), address(F.col("url"))))
    rows = common.join_sized(rows, found.withColumn("hit", F.lit(True)), ["node"], "left")
    taken = F.when(F.col("hit"), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", taken).alias("verdict"))


@common.owned
def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"))


#: Rules and, for pages that link to other addresses of themselves, their classes by a recursive search.
ORACLE = r"""
WITH p AS (SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, h, pre) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
own AS (SELECT page_id, url, max_by(h || pre, length(h || pre)) AS rule, max_by(verdict, length(h || pre)) AS verdict
        FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id, url),
a AS (SELECT q.*, own.rule, own.verdict, host || regexp_replace(path, '/+$', '') ||
             CASE WHEN qs = '' THEN '' ELSE '?' || qs END AS node
      FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(url, '\?([^#]*)', 1),
              '(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS qs FROM q) q
      LEFT JOIN own ON own.page_id = q.page_id AND own.url = q.url),
e AS (SELECT node AS u, regexp_replace(regexp_extract(t, '://([^#]*)', 1), '/+$', '') AS v
      FROM (SELECT node, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]*)">', 1)) AS t FROM a)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (WITH RECURSIVE x(u, v) AS (SELECT u, v FROM b UNION SELECT x.u, b.v FROM x JOIN b ON x.v = b.u) SELECT * FROM x),
cls AS (SELECT reach.u, bool_or(verdict = 'allow') AS al, bool_or(verdict = 'block') AS bl FROM reach JOIN a ON a.node = reach.v GROUP BY 1)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN bl AND NOT coalesce(al, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM a LEFT JOIN cls ON cls.u = a.node
"""
