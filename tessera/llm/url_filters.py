"""URL filter by rules and redirect equivalence (DataFrame functions only).

A url's own rule decides first: rules are (host, path, verdict), fit a host with all subdomains and a path prefix, and
the longest fitting rule wins. A url that no rule fits takes the decision of its aliases. Aliases are the connected
component over redirect and canonical-link edges: links that pages declare (<link rel=canonical>, <meta refresh>), rows
of an optional redirect table, and the address without tracking parameters and trailing slash, which is its canonical
form. In a component an explicit allow takes precedence: a block spreads to the aliases without a rule only if no
member is explicitly allowed. A rule that is listed with both verdicts allows.

References in pages are resolved as in RFC 3986, against the page's address or its <base href>: with a scheme, from
"//", "/", "?" or a segment on, with dot segments removed and character references of "&" decoded. References to
fragments, and schemes without "//", are no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shared import table

#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Query parameters that only track a visit.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
#: Up to so many rules become one expression; more are joined.
INLINE_RULES = 256

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _node(url: Column) -> Column:
    """host, path and query: scheme and fragment don't make another resource. Null where there is no host."""
    rest = F.regexp_extract(url, _URL, 3)
    return F.when(url_host(url) != "", F.concat(F.regexp_replace(url_host(url), r":(80|443)$", ""), F.when(url_path(url) == "", "/").otherwise(url_path(url)), F.when(rest == "?", "").otherwise(rest)))


def _canonical(node: Column) -> Column:
    """The node without tracking parameters and without a slash at the end of its path."""
    path = F.regexp_replace(F.regexp_extract(node, r"(?s)^([^?]*)", 1), r"(?<=[^/])/$", "")
    query = F.regexp_replace(F.regexp_extract(node, r"(?s)\?(.*)$", 1), rf"(^|&)({TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def _decided(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Each rule once; allow, where both verdicts are given."""
    found: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        found[host, path] = "allow" if found.get((host, path)) == "allow" else verdict
    return [(host, path, verdict) for (host, path), verdict in found.items()]


def _fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """rule and verdict of the longest fitting rule, as a struct of nulls if none fits."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _ruled(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds fit (rule, verdict) by columns host and path. Many rules: rows meet the rules of their host's suffixes by an equi-join."""
    if len(rules) <= INLINE_RULES:
        return rows.withColumn("fit", _fitting(F.col("host"), F.col("path"), rules))
    spark = rows.sparkSession
    listed = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    keys = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = keys.withColumn("rule_host", F.explode(suffixes)).join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), F.struct(F.length(rule), rule)).alias("fit"))
    return rows.join(best, ["host", "path"], "left").withColumn("fit", F.coalesce("fit", _fitting(F.col("host"), F.col("path"), [])))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, trimmed, with references of "&" decoded; empty if it isn't there."""
    value = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\"'\s>]+)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"^[\"']|[\"']$", ""), r"(?i)&(amp;?|#0*38;|#x0*26;)", "&"))


def _tags(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)({pattern})"), F.lit(1))


def declared_links(html: Column) -> Column:
    """Targets of canonical links and meta refreshes in a page, as written."""
    links = _tags(html, r"<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>")
    metas = _tags(html, r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>")
    refresh = lambda x: F.regexp_replace(F.regexp_extract(_attribute(x, "content"), r"(?is)\burl\s*=\s*(.*)$", 1), r"^[\"']|[\"']$", "")
    targets = F.concat(F.transform(links, lambda x: _attribute(x, "href")), F.transform(metas, lambda x: F.trim(refresh(x))))
    return F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda x: x != "")


def base_reference(html: Column) -> Column:
    """The first <base href> of a page, as written; null if there is none."""
    return F.nullif(_attribute(F.regexp_extract(html, r"(?is)(<base\b[^>]*\bhref\s*=[^>]*>)", 1), "href"), F.lit(""))


def _without_dots(path: Column) -> Column:
    """An absolute path without its segments "." and ".."."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(rows: DataFrame, reference: str, base: str, name: str) -> DataFrame:
    """rows with a column: the absolute url of a reference in a page at base; null where it is none, or needs a base that has no host.

    Step by step, as an expression that names its parts many times would grow with every step.
    """
    path = F.regexp_extract("__base.2", r"(?s)^(.*/)", 1)
    steps = rows.withColumn("__base", F.struct(F.regexp_extract(base, r"(?s)^(.*?)://", 1).alias("0"), F.regexp_extract(base, _URL, 1).alias("1"), url_path(F.col(base)).alias("2")))
    steps = steps.withColumn("__bare", F.regexp_extract(reference, r"(?s)^([^#]*)", 1))
    steps = steps.withColumn("__ref", F.struct(F.regexp_extract("__bare", r"(?s)^([^?]*)", 1).alias("0"), F.regexp_extract("__bare", r"(?s)(\?.*)$", 1).alias("1")))
    steps = steps.withColumn("__path", F.when(F.col("__bare").startswith("/"), F.col("__ref.0")).otherwise(F.concat(F.when(path == "", "/").otherwise(path), F.col("__ref.0"))))
    root = F.concat("__base.0", F.lit("://"), "__base.1")
    found = (
        F.when(F.col("__bare") == "", None)
        .when(F.col("__bare").rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("__bare"))
        .when(F.col("__bare").rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:") | (F.col("__base.1") == ""), None)
        .when(F.col("__bare").startswith("//"), F.concat("__base.0", F.lit(":"), "__bare"))
        .when(F.col("__bare").startswith("?"), F.concat(root, F.when(F.col("__base.2") == "", "/").otherwise(F.col("__base.2")), "__bare"))
        .otherwise(F.concat(root, "__path", "__ref.1"))
    )
    return steps.withColumn("__path", _without_dots(F.col("__path"))).withColumn(name, found).drop("__base", "__bare", "__ref", "__path")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict, via_alias.

    redirects: optional rows (src_url, dst_url). A null url, or one without "://", has an empty host and path, no rule
    and no aliases, and is allowed; a null html declares no links. Repeated rows are judged alike. Other columns of
    pages are ignored. An empty table gives an empty result.
    """
    rules = _decided(rules)
    url = F.col("url").cast("string")
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    base = pages.select("page_id", url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"), _node(url).alias("node"))
    linked = pages.select(url.alias("url"), base_reference(html).alias("base"), declared_links(html).alias("links")).where(F.size("links") > 0)
    linked = resolved(linked, "base", "url", "base").select("url", F.coalesce("base", "url").alias("base"), F.explode("links").alias("to"))
    edges = resolved(linked, "to", "base", "to").where("to is not null").select(_node(F.col("url")).alias("src"), _node(F.col("to")).alias("dst"))
    if redirects is not None:
        edges = edges.union(redirects.select(_node(F.col("src_url")), _node(F.col("dst_url"))))
    ends = edges.where("dst is not null").select(F.explode(F.array("src", "dst")).alias("node")).union(base.select("node"))
    own_form = ends.distinct().select(F.col("node").alias("src"), _canonical(F.col("node")).alias("dst"))
    component = connected_components(edges.union(own_form))
    at = component.select("node", "component", F.regexp_extract("node", r"(?s)^([^/?]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1).alias("path"))
    judged = _ruled(at, rules).groupBy("component").agg(F.max(F.col("fit.verdict") == "block").alias("blocked"), F.max(F.col("fit.verdict") == "allow").alias("allowed"))
    spread = judged.where("blocked and not coalesce(allowed, false)").select("component")
    blocked = component.join(spread, "component", "left_semi").select("node", F.lit(True).alias("alias_blocked"))
    return (
        _ruled(base, rules)
        .join(blocked, "node", "left")
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("alias_blocked"), "block").otherwise("allow")).alias("verdict"), (F.col("fit.rule").isNull() & F.coalesce("alias_blocked", F.lit(False))).alias("via_alias"))
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


#: No page of the driver's tables declares a link, so components there are the groups of one canonical form.
OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 2), '') AS path,
         regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 3) AS query
  FROM pages),
hosts AS (SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
forms AS (
  SELECT *, CASE WHEN host = '' THEN NULL ELSE
      regexp_replace(host, ':(80|443)$', '')
      || CASE WHEN path IN ('', '/') THEN '/' WHEN path LIKE '%[^/]/' OR regexp_matches(path, '[^/]/$') THEN substr(path, 1, length(path) - 1) ELSE path END
      || CASE WHEN regexp_replace(regexp_replace(substr(query, 2), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') = '' THEN ''
              ELSE '?' || regexp_replace(regexp_replace(substr(query, 2), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') END END AS form
  FROM hosts),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
addresses AS (SELECT DISTINCT host, path, form FROM forms UNION
  SELECT host, regexp_replace(path, '([^/])/$', '\1'), form FROM forms),
fit AS (
  SELECT DISTINCT host, path, form, (SELECT rule_host || rule_path FROM rules r WHERE (a.host = rule_host OR a.host LIKE '%.' || rule_host) AND starts_with(a.path, rule_path) ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS rule
  FROM addresses a),
named AS (SELECT f.*, r.verdict FROM fit f LEFT JOIN rules r ON f.rule = r.rule_host || r.rule_path),
groups AS (SELECT form, bool_or(verdict = 'block') AS blocked, bool_or(verdict = 'allow') AS allowed FROM named WHERE form IS NOT NULL GROUP BY form)
SELECT f.page_id, f.host, f.path, n.rule,
       coalesce(n.verdict, CASE WHEN g.blocked AND NOT coalesce(g.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict,
       n.rule IS NULL AND coalesce(g.blocked AND NOT coalesce(g.allowed, false), false) AS via_alias
FROM forms f
LEFT JOIN named n ON n.host = f.host AND n.path = f.path AND n.form IS NOT DISTINCT FROM f.form
LEFT JOIN groups g ON g.form = f.form
"""
