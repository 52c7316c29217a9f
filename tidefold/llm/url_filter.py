"""URL filters with redirect equivalence.

A page's address is its host, path and query; the fragment is no part of it.  Edges join addresses that stand for one another: a page's
address and those that its html names by ``<link rel=canonical>`` or ``<meta http-equiv=refresh>``, outside of comments, scripts, styles and
templates; ``&amp;`` is decoded, and targets without a host are resolved against the page's address.  A tag that holds ``<`` or ``>`` in
an attribute is not read.  ``ORACLE`` reads absolute targets only.  Distributed connected components over the edges give the aliases.

A page that a rule fits has that rule's verdict; of several the longest wins.  Any other page is allowed if a
page of its component is allowed by a rule or an address of it is, else blocked if one is blocked, else allowed: an explicit allow goes
before a block.

``judge`` returns one row per row of the input: ``page_id, host, path, rule, verdict``.  A null url, or one
without ``://``, has an empty host and path, no rule and no aliases, and is allowed.  Null html has no edges.
Repeated rows are judged alike.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm._shared import Tables, components, lower_ascii, own_columns

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)((?:\?[^#]*)?)"
#: What a browser reads no tags in.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|template)\b.*?(?:</(?:script|style|template)\b|\z)"
LINK, META = r"(?is)<link\b[^<>]*>", r"(?is)<meta\b[^<>]*>"
VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
REFRESH_TO = r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)"""


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 3), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without its quotes; empty if there is none."""
    # a name that only ends like this one (data-rel) is another
    found = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}{VALUE}""", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(found, "^[\"']|[\"']$", ""), "(?i)&(?:amp|#0*38|#x0*26);", "&"))


def targets(html: Column) -> Column:
    """What a page names as its canonical address or the one that it sends its readers on to."""
    read = F.regexp_replace(html, UNREAD, " ")
    canonical = F.filter(F.regexp_extract_all(read, F.lit(LINK), F.lit(0)), lambda x: F.array_contains(F.split(F.lower(attribute(x, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(F.regexp_extract_all(read, F.lit(META), F.lit(0)), lambda x: F.lower(attribute(x, "http-equiv")) == "refresh")
    return F.concat(F.transform(canonical, lambda x: attribute(x, "href")), F.transform(refresh, lambda x: F.trim(F.regexp_extract(attribute(x, "content"), REFRESH_TO, 1))))


def resolved(to: Column) -> Column:
    """The address that a target names on the page with ``host``, ``path`` and ``query``; null if it names none."""
    # a scheme with no host (mailto:, javascript:) names no page
    own = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    asked = F.regexp_extract(to, r"(?s)^[^?#]*(\?[^#]*)", 1)
    base = F.when(own == "", F.col("path")).when(own.startswith("/"), own).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract("path", r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")), own))
    parts = F.split(F.regexp_replace(base, "^/", ""), "/")
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    # a last part of dots stands for the folder
    tail = F.when(base.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    walked = F.concat(F.aggregate(parts, F.array().cast("array<string>"), up), tail)
    dotted = F.when(base.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(base)
    full = F.when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
    here = F.concat("host", dotted, F.when((own == "") & (asked == ""), F.col("query")).otherwise(asked))
    return F.when(full.isNotNull(), F.concat(host(full), path(full), query(full))).when((to != "") & ~to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), here)


def rule_struct(h: Column, p: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as (verdict, rule), or null."""
    found = None
    for verdict, rh, rp in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rh + rp).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<verdict: string, rule: string>")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    tables = Tables(pages.sparkSession, "url-filter")
    p = own_columns(pages, "page_id", "url", "html")
    p = p.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("query", query(F.col("url")))
    has = F.col("html").rlike("(?i)canonical|refresh")
    edges = p.where(has & (F.col("host") != "")).select("host", "path", "query", F.explode(targets(F.col("html"))).alias("to"))
    edges = edges.select(F.concat("host", "path", "query").alias("a"), resolved(F.col("to")).alias("b")).where("a <> b").distinct()
    edges = tables.keep(edges)
    rule = rule_struct(F.col("host"), F.col("path"), rules)
    if edges.isEmpty():
        judged = p.withColumn("r", rule).withColumn("theirs", F.lit(None).cast("string"))
    else:
        members = tables.keep(components(edges, tables))
        own = members.withColumn("r", rule_struct(F.regexp_extract("id", r"(?s)^([^/?]*)", 1), F.regexp_extract("id", r"(?s)^[^/?]*([^?]*)", 1), rules))
        verdicts = own.groupBy("component").agg(F.when(F.bool_or(F.col("r.verdict") == "allow"), "allow").when(F.bool_or(F.col("r.verdict") == "block"), "block").alias("theirs"))
        theirs = members.join(verdicts.where("theirs is not null"), "component").select("id", "theirs")
        judged = p.withColumn("id", F.concat("host", "path", "query")).join(theirs, "id", "left").withColumn("r", rule)
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "theirs", F.lit("allow")).alias("verdict"))


def _attribute_sql(name: str) -> str:
    found = rf"""regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    return rf"""trim(regexp_replace(regexp_replace({found}, '^["'']|["'']$', '', 'g'), '(?i)&(?:amp|#0*38|#x0*26);', '&', 'g'))"""


#: The same in DuckDB's SQL, with absolute targets only.
ORACLE = rf"""
WITH RECURSIVE
p AS (
  SELECT page_id, html,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) ELSE '' END AS query,
    regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<(?:script|style|template)\b.*?(?:</(?:script|style|template)\b|\z)', ' ', 'g') AS read
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (
  SELECT host || path || query AS a, unnest(list_concat(regexp_extract_all(read, '(?is)<link\b[^<>]*>'), regexp_extract_all(read, '(?is)<meta\b[^<>]*>'))) AS tag
  FROM p WHERE host <> ''),
attributes AS (
  SELECT a, lower(tag[2:5]) AS name, {_attribute_sql("rel")} AS rel, {_attribute_sql("href")} AS href, {_attribute_sql("http-equiv")} AS equiv, {_attribute_sql("content")} AS content FROM tags),
named AS (
  SELECT a, CASE WHEN name = 'link' THEN href ELSE trim(regexp_extract(content, '(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1)) END AS t
  FROM attributes WHERE CASE WHEN name = 'link' THEN list_contains(string_split_regex(lower(rel), '\s+'), 'canonical') ELSE lower(equiv) = 'refresh' END),
one AS (
  SELECT a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(t, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS b
  FROM named WHERE regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://')),
edges AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach(a, b) AS (SELECT DISTINCT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
address AS (SELECT DISTINCT b, regexp_extract(b, '(?s)^([^/?]*)', 1) AS host, regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1) AS path FROM reach),
their_rule AS (
  SELECT b, arg_max(verdict, length(rhost || rpath)) AS verdict FROM address JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY b),
theirs AS (SELECT a, min(verdict) AS verdict FROM reach JOIN their_rule USING (b) GROUP BY a),
own AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, p.host, p.path, own.rule AS rule, coalesce(own.verdict, theirs.verdict, 'allow') AS verdict
FROM p LEFT JOIN own ON p.host = own.host AND p.path = own.path LEFT JOIN theirs ON p.host || p.path || p.query = theirs.a
"""
