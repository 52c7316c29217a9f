"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

For each distinct line, trimmed of ASCII white space, a HyperLogLog sketch counts the distinct sites (values of ``source``, null
being one of them) it stands on; sketches of tasks are merged by aggregation.  Lines whose estimate is further than
``BAND`` (relative) from the threshold are decided by it; those near it get an exact distinct count.  A line
on ``sites`` sites or more is boilerplate and is removed from every document, however much of it that is; ``removed_chars``
says how much.  A caller that goes on to remove near copies may leave those documents whole of whose characters in lines more than
``most_percent`` in a hundred (100 by default, that is none) would go: a text copied to many sites is no boilerplate, and should be kept once.

``clean`` returns one row per row of the input: its ``doc_id``, ``text`` without the removed lines, ``n_lines``
(lines with a character other than ASCII white space), ``n_removed`` and ``removed_chars`` (of the removed lines, trimmed).  Lines are separated by line feeds; blank lines
are never removed, and a text from which nothing is removed comes back as it was.  A null text stays null with no
lines.  Rows are told apart by ``doc_id`` and text, so that repeated rows are cleaned alike, and null ids are cleaned
too.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm._shared import Tables, own_columns

SITES, LG_K, BAND = 8, 12, 0.1
TRIM = " \t\n\v\f\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIM))


def boilerplate(docs: DataFrame, tables: Tables, sites: int = SITES) -> DataFrame:
    """``h``: the hashes of the lines that stand on ``sites`` sites or more."""
    lines = docs.select(F.coalesce("source", F.lit("\0")).alias("site"), F.explode(F.array_distinct(F.transform(F.split("text", "\n"), trimmed))).alias("line")).where("line <> ''")
    lines = lines.select("site", line_hash(F.col("line")).alias("h"))
    spread = lines.groupBy("h").agg(F.count("*").alias("k"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = tables.keep(spread.where(F.col("k") >= sites).select("h", F.hll_sketch_estimate("sketch").alias("about")))
    sure = spread.where(F.col("about") > sites * (1 + BAND)).select("h")
    near = spread.where(F.col("about").between(sites * (1 - BAND) - 1, sites * (1 + BAND))).select("h")
    exact = lines.join(near, "h", "left_semi").distinct().groupBy("h").count().where(F.col("count") >= sites).select("h")
    return tables.keep(sure.unionByName(exact))


def line_hash(line: Column) -> Column:
    """Two independent 64-bit hashes: among 10**14 distinct lines, two that meet are as likely as one in 10**10."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line, F.length(line)).alias("y"))


def clean(docs: DataFrame, sites: int = SITES, most_percent: int = 100, carry: list[str] | None = None) -> DataFrame:
    """See the module.  ``carry``: further columns to return, in the struct ``row``."""
    tables = Tables(docs.sparkSession, "line-dedup")
    if carry:
        docs = docs.withColumn("row", F.struct(*[F.col(f"`{c}`") for c in carry if c != "text"]))
    d = own_columns(docs, "doc_id", "source", "text", *["row"] * bool(carry)).withColumn("source", F.col("source").cast("string"))
    common = boilerplate(d, tables, sites)
    # of a row: two hashes, since ids may be null or repeated
    d = d.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "text", "doc_id"))
    lines = F.split("text", "\n")
    held = d.select("k1", "k2", F.posexplode(F.transform(lines, trimmed)).alias("at", "line")).where("line <> ''").select("k1", "k2", F.struct("at", F.length("line").alias("size")).alias("gone"), line_hash(F.col("line")).alias("h"))
    # a set, at most the document's own lines, however often the row is repeated
    found = held.join(common, "h").groupBy("k1", "k2").agg(F.collect_set("gone").alias("gone"))
    d = d.join(found, ["k1", "k2"], "left")
    # by place and with a set operation, in time proportional to the lines; the lines are a variable, so that they are split once
    rest = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.transform("gone", lambda x: x["at"]))
    left = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(rest(ls), lambda i: F.get(ls, i)), "\n"))[0]
    size = lambda xs, of: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + of(x))
    if most_percent < 100:
        whole = 100 * size(F.col("gone"), lambda x: x["size"]) > most_percent * size(lines, lambda x: F.length(trimmed(x)))
        d = d.withColumn("gone", F.when(F.col("gone").isNotNull() & ~whole, F.col("gone")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    full = F.size(F.filter(lines, lambda x: trimmed(x) != ""))
    return d.select("doc_id", text.alias("text"), F.when(F.col("text").isNotNull(), full).otherwise(0).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"), F.when(F.col("gone").isNull(), 0).otherwise(size(F.col("gone"), lambda x: x["size"])).alias("removed_chars"), *["row"] * bool(carry))


def sql(docs: str = "documents", most_percent: int = 100) -> str:
    """The same in DuckDB's SQL over the relation ``docs``, with exact counts throughout."""
    trim = "trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS lines FROM {docs}),
l AS (SELECT r, site, x, {trim} AS line, i FROM (SELECT r, site, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM d)),
common AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {SITES}),
b AS (
  SELECT r, string_agg(x, chr(10) ORDER BY i) FILTER (c.line IS NULL) AS rest, count(*) FILTER (l.line <> '') AS n, count(c.line) AS gone, sum(CASE WHEN c.line IS NULL THEN 0 ELSE length(l.line) END) AS chars
    , sum(length(l.line)) AS all_chars
  FROM l LEFT JOIN common c ON c.line = l.line GROUP BY r),
a AS (SELECT r, rest, n, gone, chars, 100 * chars > {most_percent} * all_chars AS whole FROM b)
SELECT doc_id, CASE WHEN whole THEN text WHEN text IS NOT NULL THEN coalesce(rest, '') END AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_lines, CAST(CASE WHEN whole THEN 0 ELSE coalesce(gone, 0) END AS INTEGER) AS n_removed, CAST(CASE WHEN whole THEN 0 ELSE coalesce(chars, 0) END AS BIGINT) AS removed_chars
FROM d LEFT JOIN a USING (r)
"""


ORACLE = sql()
