"""URL filters with redirect equivalence, in DataFrame operations only.

Host and path rules judge the URLs that they fit. Redirects and canonical links make URLs aliases of one another; the
connected components over those edges carry block decisions to aliases that no rule fits, unless a member of the component
is explicitly allowed: then its unruled members are allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import components, stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rules that the registered query applies.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host: after the first :// up to /, ?, # or the end; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: from the host's end up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What identifies a page: the URL with its scheme and host in lower case and without its fragment; null without ://.

    A fragment never reaches a server, so URLs that differ in it alone are one page.
    """
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.translate(scheme, UPPER, LOWER), F.lit("://"), host_of(url), rest))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (host or a parent domain of it, path prefix) as text, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


#: An attribute's value, in either kind of quotes or bare: one of three groups.
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
LINK, META, HREF = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>", rf"(?is)\shref{VALUE}"
CANONICAL = r"""(?is)\srel\s*=\s*(?:"[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*'|canonical\b)"""
REFRESH, REFRESHED = r"""(?is)\shttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\burl\s*=\s*['"]?([^"'>]+)"""
#: Named and numbered characters that occur in addresses; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(text)


def merged_path(base: Column, relative: Column) -> Column:
    """The path of a reference relative to a page's path, with . and .. resolved."""
    steps = F.split(F.concat(F.regexp_extract(base, r"(?s)^(.*/)", 1), relative), "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda path, x: F.when(x == "..", F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(1)))).when(x == ".", path).otherwise(F.concat(path, F.array(x))),
    )
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.regexp_replace(F.concat(F.array_join(kept, "/"), ends), "^/+", ""))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) addresses that a page's canonical links and immediate refreshes declare to be one page.

    A target with a scheme stands as it is; //host/... takes the page's scheme, /... its scheme and host, ?... its path too, and any
    other is relative to the path. Targets of other kinds than addresses (mailto: and the like) aren't followed, nor are <base> elements.
    """
    lower = F.lower("html")
    linked = pages.where("html is not null and url is not null").where(F.contains(lower, F.lit("canonical")) | F.contains(lower, F.lit("http-equiv")))
    links = F.filter(F.regexp_extract_all("html", F.lit(LINK), 0), lambda x: F.rlike(x, F.lit(CANONICAL)))
    metas = F.filter(F.regexp_extract_all("html", F.lit(META), 0), lambda x: F.rlike(x, F.lit(REFRESH)))
    href = F.transform(links, lambda x: F.concat(*(F.regexp_extract(x, HREF, i) for i in (1, 2, 3))))
    url = F.transform(metas, lambda x: F.regexp_extract(x, REFRESHED, 1))
    found = linked.select("url", F.explode(F.transform(F.concat(href, url), decoded)).alias("to")).where("to <> ''")
    page, to = F.col("url"), F.col("to")
    scheme = F.regexp_extract(page, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(page))
    rest, query = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*([?][^#]*)", 1)
    own = F.when(path_of(page) == "", F.lit("/")).otherwise(path_of(page))
    full = (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(site, to))
        .when(F.startswith(to, F.lit("?")), F.concat(site, own, query))
        .when(~F.startswith(to, F.lit("#")), F.concat(site, merged_path(own, rest), query))
    )
    return found.select(address(page).alias("a"), address(full).alias("b"))


def judge(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
) -> DataFrame:
    """Verdicts for the URLs of pages (id_col, url, html).

    redirects: further (a, b) pairs of URLs, such as those of a crawl's 3xx answers. Returns id_col, host, path, rule, verdict and
    component (the smallest address of the page's aliases, null where it has none). A fitting rule decides by itself. Else a
    page takes block if its component has a blocked member and no allowed one, and allow otherwise: an explicit allow wins
    over blocks among aliases. Null URLs and those without :// have empty host and path, no alias, and are allowed. Repeated
    rows are judged each; empty tables give an empty result; other columns are ignored.
    """
    urls = pages.select(id_col, "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = (
        urls.select(id_col, "url", host.alias("host"), path.alias("path"))
        .withColumns({"rule": rule, "ruled": verdict})
        .withColumn("node", address(F.col("url")))
    )
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("a")), address(F.col("b"))))
    member = components(edges, "redirects")
    # aliases count whether or not they were crawled themselves: the rules apply to the addresses
    _, of_node = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    said = (
        member.withColumn("ruled", of_node)
        .groupBy("component")
        .agg(F.max(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("allows"), F.max(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocks"))
    )
    spread = stage_table(member.join(said, "component"), "aliases")
    return judged.join(spread, "node", "left").select(
        id_col,
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when((F.col("blocks") == 1) & (F.col("allows") == 0), "block").otherwise("allow")).alias("verdict"),
        "component",
    )


def op2(pages: DataFrame) -> DataFrame:
    """The digest query: page_id, host, path, rule, verdict."""
    return judge(pages).drop("component")


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


DECODED = "x"
for _entity, _character in ENTITIES:
    DECODED = f"replace({DECODED}, {sql_text(_entity)}, {sql_text(_character)})"
FOLDED = f"translate({{}}, '{UPPER}', '{LOWER}')"

SQL = (
    r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
    CASE WHEN strpos(url, '://') > 0 THEN FOLD(substr(url, 1, strpos(url, '://') - 1)) END AS scheme
  FROM pages),
split AS (
  SELECT *, coalesce(FOLD(regexp_extract(rest, '^[^/?#]*')), '') AS host,
    coalesce(substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1), '') AS path,
    scheme || '://' || FOLD(regexp_extract(rest, '^[^/?#]*'))
      || substr(regexp_extract(rest, '^[^#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS node
  FROM parts),
found AS (
  SELECT node, scheme, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, unnest(list_transform(list_concat(
    list_transform(list_filter(regexp_extract_all(html, LINK), lambda x: regexp_matches(x, CANONICAL)), lambda x: regexp_extract(x, HREF, 1) || regexp_extract(x, HREF, 2) || regexp_extract(x, HREF, 3)),
    list_transform(list_filter(regexp_extract_all(html, META), lambda x: regexp_matches(x, REFRESH)), lambda x: regexp_extract(x, TARGET, 1))), lambda x: trim(DECODED))) AS t
  FROM split WHERE node IS NOT NULL),
steps AS (SELECT *, string_split(regexp_extract(path, '^.*/') || regexp_extract(t, '^[^?#]*'), '/') AS s FROM found WHERE t <> ''),
resolved AS (
  SELECT node, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(t, '#') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || host || t
    WHEN starts_with(t, '?') THEN scheme || '://' || host || path || regexp_extract(t, '^[?][^#]*')
    ELSE scheme || '://' || host || '/' || regexp_replace(
      array_to_string(list_reduce(list_transform(s, lambda x: [x]), lambda p, x: CASE WHEN x = ['..'] THEN p[1:greatest(len(p) - 1, 1)] WHEN x = ['.'] THEN p ELSE p || x END), '/')
      || CASE WHEN s[-1] IN ('.', '..') THEN '/' ELSE '' END, '^/+', '') || regexp_extract(t, '[?][^#]*') END AS t
  FROM steps),
edges AS (
  SELECT node AS a, FOLD(regexp_extract(t, '^[^:]*://[^/?#]*')) || substr(regexp_extract(t, '^[^#]*'), length(regexp_extract(t, '^[^:]*://[^/?#]*')) + 1) AS b
  FROM resolved WHERE t IS NOT NULL),
ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.other = w.a),
addresses AS (
  SELECT node, other, split_part(regexp_extract(other, '://[^/?#]*'), '://', 2) AS h,
    substr(regexp_extract(other, '^[^?#]*'), length(regexp_extract(other, '^[^:]*://[^/?#]*')) + 1) AS p FROM reach),
alias AS (
  SELECT node, max(CASE WHEN r = 'allow' THEN 1 ELSE 0 END) AS allows, max(CASE WHEN r = 'block' THEN 1 ELSE 0 END) AS blocks FROM (
    SELECT node, CASE
      WHEN ('.' || h) LIKE '%.www.example.com' AND p LIKE '/en/%' THEN 'allow' WHEN ('.' || h) LIKE '%.example.com' AND p LIKE '/en/%' THEN 'block'
      WHEN ('.' || h) LIKE '%.net' AND (p LIKE '/es/%' OR p LIKE '/fr/%') THEN 'block' WHEN ('.' || h) LIKE '%.com' AND p LIKE '/%' THEN 'allow' END AS r
    FROM addresses) GROUP BY node),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM split)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN blocks = 1 AND allows = 0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN alias USING (node)
"""
    .replace("CANONICAL", sql_text(CANONICAL))
    .replace("LINK", sql_text(LINK))
    .replace("META", sql_text(META))
    .replace("HREF", sql_text(HREF))
    .replace("REFRESH", sql_text(REFRESH))
    .replace("TARGET", sql_text(REFRESHED))
    .replace("DECODED", DECODED)
)
SQL = re.sub(r"FOLD\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", lambda m: FOLDED.format(m[1]), SQL)
