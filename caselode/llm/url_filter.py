"""URL rules whose block decisions reach all aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stage_table
from .components import connected_components

#: Rules of the registered query: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, action string"
#: Rules up to this number are sent to every task; more of them are joined by key.
SENT_RULES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_ATTR = r"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://" + pattern, 1), F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; empty where there is none."""
    return _ascii_lower(_part(url, r"([^/?#]*)"))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is no ://."""
    return _part(url, r"[^/?#]*([^?#]*)")


def node_of(url: Column) -> Column:
    """The resource that a URL names: without its fragment, scheme and host in lower case; null without ://."""
    scheme = _ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTR.replace("{name}", name)
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _resolved(url: Column, to: Column) -> Column:
    """The address that a link on the page url leads to: absolute, or relative to scheme, host or folder."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, path_of(url), to))
        .otherwise(F.concat(root, folder, to))
    )


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url): where a page says that its canonical address is elsewhere, or sends readers on.

    Read are <link rel="canonical" href> and <meta http-equiv="refresh"
    content="n; url=...">, outside comments. A page may name several; empty
    addresses and pages without a URL give no row.
    """
    rows = pages.select(F.col(url_col).alias("from_url"), F.col(html_col).alias("html"))
    rows = rows.where(F.contains("from_url", F.lit("://")) & F.col("html").rlike(r"(?i)canonical|refresh"))
    plain = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    tags = rows.select("from_url", F.explode(F.regexp_extract_all(plain, F.lit(_TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = tag.rlike(r"(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = tag.rlike(r"(?i)^<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh")
    target = F.when(canonical, _attribute(tag, "href")).when(
        refresh, F.regexp_extract(_attribute(tag, "content"), r"""(?i)url\s*=\s*["']?([^"']*)""", 1)
    )
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    return tags.select("from_url", target.alias("to")).where("to <> ''").select("from_url", _resolved(F.col("from_url"), F.col("to")).alias("to_url"))


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (any columns, with host and path) with rule and action of the longest rule that fits, null where none does.

    A host is looked up by each of its suffixes, a path by its beginnings of
    the lengths that rules of that host have; so the rules are found by equal
    keys, and a URL meets no more rules than those that fit it. Rules that
    repeat host and path allow if one of them does.
    """
    rules = rules.select(_ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action").where("rule_host <> ''")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.min("action").alias("action"))  # allow sorts before block
    rules = stage_table(rules, "rules")
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    if rules.count() <= SENT_RULES:
        rules, lengths = F.broadcast(rules), F.broadcast(lengths)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = [F.col(f"`{c}`") for c in urls.columns]
    distinct = urls.select("host", "path").distinct()
    tried = distinct.select("host", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    tried = tried.select("host", "path", "rule_host", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    tried = tried.withColumn("rule_path", F.expr("left(path, n)"))
    fits = tried.join(rules, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), F.col("action").alias("action")))
    best = fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.action")
    return urls.join(best, ["host", "path"], "left").select(*keys, "rule", "action")


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of each page, and its alias class.

    rules holds host, path and action (allow or block). A rule fits its host
    and all subdomains where the URL's path begins with the rule's; of several
    the longest decides (host and path together, then the longer host).

    Pages that no rule names follow their aliases: redirects and canonical
    links (from_url, to_url; `links`, or those that the pages' html names)
    make all URLs that they join one class, and where a URL of the class is
    blocked the pages of the class are blocked too, unless another URL of it
    is allowed by a rule: an explicit allow goes before a block, for the URL
    itself and for its class. Otherwise a page is allowed. URLs that differ
    in their fragment or in capitals of scheme and host are one resource.
    Ends of links that are no pages are judged by the rules as well.

    Classes come from distributed connected components; only URLs with links
    take part, and a URL that very many links share is a hub there, whose
    links are combined before they are shuffled. alias is the smallest URL of
    the class, null for pages without links.

    Defined cases: a null URL or one without :// has an empty host and path,
    fits no rule and is allowed; null html has no links; repeated rows are
    judged alike and stay; a null id stays null; other columns are ignored;
    an empty table gives an empty result; without rules everything is allowed.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    if links is None:
        links = page_links(pages, url_col=url_col, html_col=html_col)
    edges = links.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).distinct()
    classes = stage_table(connected_components(stage_table(edges, "url-links")), "url-classes")
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = stage_table(matched_rules(urls, rules).withColumn("node", node_of(F.col("url"))), "urls")
    if classes.limit(1).count():
        # The ends of links are judged as pages are, then each class by its ends.
        ends = classes.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
        decided = matched_rules(ends, rules).where("action is not null").groupBy("component").agg(F.min("action").alias("class_action"))
        decided = classes.join(decided, "component", "left").select("node", F.col("component").alias("alias"), "class_action")
        urls = stage_table(urls.join(decided, "node", "left"), "judged-urls")
    else:
        urls = urls.withColumns({"alias": F.lit(None).cast("string"), "class_action": F.lit(None).cast("string")})
    verdict = F.coalesce("action", "class_action", F.lit("allow"))
    judged = urls.select("url", "n", "host", "path", "rule", verdict.alias("verdict"), "alias")
    return spread_join(rows, judged, ["url"], "n", ["page_id"]).select("page_id", "host", "path", "rule", "verdict", "alias")


def query(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).drop("alias")


_SQL_PARTS = r"""
  translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_SQL_HOST = _SQL_PARTS.strip()
_SQL_PATH = r"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_SQL_NODE = (
    r"CASE WHEN contains({u}, '://') THEN concat(translate(regexp_extract({u}, '(?s)^(.*?)://', 1), "
    r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '://', {host}, regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)) END"
)


def _sql(template: str, u: str) -> str:
    return template.replace("{host}", _SQL_HOST).replace("{u}", u)


def _sql_attribute(name: str) -> str:
    pattern = _ATTR.replace("{name}", name).replace("'", "''")
    return "concat(" + ", ".join(f"regexp_extract(tag, '{pattern}', {i})" for i in (1, 2, 3)) + ")"


ORACLE_SQL = rf"""
WITH RECURSIVE rules(rule_host, rule_path, action) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)}),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '{_TAG}')) AS tag
  FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|refresh')),
targets AS (
  SELECT url, trim(replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(string_split_regex(lower({_sql_attribute("rel")}), '\s+'), 'canonical')
      THEN {_sql_attribute("href")}
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim({_sql_attribute("http-equiv")})) = 'refresh'
      THEN regexp_extract({_sql_attribute("content")}, '(?i)url\s*=\s*["'']?([^"'']*)', 1) END, '&amp;', '&')) AS target
  FROM tags),
links AS (
  SELECT url AS from_url, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN concat(regexp_extract(url, '(?s)^(.*?:)//', 1), target)
    WHEN starts_with(target, '/') THEN concat(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), target)
    WHEN starts_with(target, '?') THEN concat(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), {_sql(_SQL_PATH, "url")}, target)
    ELSE concat(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1),
      coalesce(nullif(regexp_extract({_sql(_SQL_PATH, "url")}, '(?s)^(.*/)', 1), ''), '/'), target) END AS to_url
  FROM targets WHERE target <> ''),
edges AS (
  SELECT {_sql(_SQL_NODE, "from_url")} AS a, {_sql(_SQL_NODE, "to_url")} AS b FROM links),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
urls AS (
  SELECT url, {_sql(_SQL_HOST, "url")} AS host, {_sql(_SQL_PATH, "url")} AS path, {_sql(_SQL_NODE, "url")} AS node
  FROM (SELECT DISTINCT coalesce(url, '') AS url FROM pages UNION SELECT b FROM reach)),
ruled AS (
  SELECT url, host, path, node, max_by(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
         max_by(action, (length(rule_host || rule_path), length(rule_host))) AS action
  FROM urls LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY url, host, path, node),
inherited AS (
  SELECT r.a AS node, min(u.action) AS action FROM reach r JOIN ruled u ON u.url = r.b GROUP BY r.a)
SELECT p.page_id, u.host, u.path, u.rule, coalesce(u.action, i.action, 'allow') AS verdict
FROM pages p JOIN ruled u ON u.url = coalesce(p.url, '') LEFT JOIN inherited i ON i.node = u.node
"""
