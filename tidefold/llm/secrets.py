"""Secret scans with multipart credential linking.

Base kinds are found by their patterns alone.  Weak candidates, an identifier, a secret or an endpoint that may as well be
harmless, are reported only when complementary parts start within ``SCOPE`` code points of each other in the same document (where
they end does not matter): an identifier or an endpoint next to a secret, a secret next to one of those.  Base findings are parts too: an
access key is an identifier, an assignment or a hex run a secret.  An endpoint is a URL, or a dotted host name (no empty label)
with a port of two to five digits.  The parts are joined by interval: each
document is cut into bins of SCOPE code points, of each part a bin keeps its first and last place, and a candidate looks at its
own bin and both beside it, which decides exactly and never pairs parts.

``scan`` returns one row per row of the input: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.  Spans are
``kind:start:end`` in code points, end exclusive, by start, then kind in the order of ``KINDS``, comma-joined; base ones all stay, weak ones
that overlap a base one are left out.  A null or empty text has none: empty ``spans`` and the hash of the empty string.  Repeated rows get
the same result each, null ids stay null.  Further columns are ignored.

No pattern repeats a group, tries a run of characters from more than one place or gives characters back, so that the time is in
proportion to the text whatever it holds, and so is that of the windows over its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm._shared import Tables, own_columns

SCOPE = 256
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Patterns of the kinds.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"(?i)\b(?:user|user_?name|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"
SECRET = r"[A-Za-z0-9+/_-]{20,}={0,2}"
URL = r"https?://[^\x20\x09-\x0D\"'<>]+"
#: A whole run of host characters and a number; ``_endpoint`` looks at its parts.
ENDPOINT = URL + r"|(?<![a-z0-9.-])[a-z0-9.-]++:[0-9]++"
MAY_ENDPOINT = r"https?://|[a-z0-9-]:[0-9]{2}"
LEAST_ASSIGNED = 6


def _endpoint(match: Column) -> Column:
    """Whether what ``ENDPOINT`` matches is an endpoint."""
    host, port = F.substring_index(match, ":", 1), F.substring_index(match, ":", -1)
    named = host.contains(".") & ~host.contains("..") & ~host.startswith(".") & ~host.endswith(".")
    return match.contains("://") | named & F.length(port).between(2, 5)


def _found(kind: str, pattern: str, gate: Column) -> Column:
    """The matches of a pattern in ``text`` with their number and the length of the text between each and the one before."""
    between = F.transform(F.split("text", pattern, -1), F.length)
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    both = F.filter(F.arrays_zip(between.alias("gap"), matches.alias("match")), lambda x: x["match"].isNotNull())
    rows = F.transform(both, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["match"].alias("match")))
    return F.when(gate, rows).otherwise(F.lit(None))


def scan(docs: DataFrame) -> DataFrame:
    d = own_columns(docs, "doc_id", "text")
    # of a row: two hashes, since ids may be null or repeated
    d = d.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "text", "doc_id"))
    has = {k: F.col("text").rlike(p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("identifier", IDENTIFIER), ("secret", SECRET), ("endpoint", MAY_ENDPOINT))}
    g = d.select("k1", "k2", "text", *[x.alias(f"has_{k}") for k, x in has.items()])
    names, secrets = F.col("has_access") | F.col("has_identifier") | F.col("has_endpoint"), F.col("has_assign") | F.col("has_hex") | F.col("has_secret")
    g = g.where("has_assign or has_access or has_hex or has_identifier and has_secret or has_endpoint and has_secret")
    gates = {"assign": F.col("has_assign"), "access": F.col("has_access"), "hex": F.col("has_hex"), "identifier": F.col("has_identifier") & secrets, "secret": F.col("has_secret") & names, "endpoint": F.col("has_endpoint") & secrets}
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "secret": SECRET, "endpoint": ENDPOINT}
    empty = F.array().cast("array<struct<kind: int, i: int, gap: int, match: string>>")
    g = g.select("k1", "k2", F.inline(F.concat(*[F.coalesce(_found(k, patterns[k], gates[k]), empty) for k in KINDS]))).distinct()
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto)).withColumn("start", F.col("end") - F.length("match"))
    kind = F.col("kind")
    fits = F.when(kind == 0, F.length(F.regexp_extract("match", ASSIGN, 2)) >= LEAST_ASSIGNED).when(kind == 4, F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]")).when(kind == 5, _endpoint(F.col("match"))).otherwise(True)
    part = F.when(kind.isin(1, 3), "id").when(kind == 5, "end").otherwise("secret")
    # the few rows found are written, so that the texts are searched once
    parts = Tables(docs.sparkSession, "secrets").keep(g.where(fits).select("k1", "k2", "kind", "start", "end", part.alias("part"), F.expr(f"start div {SCOPE}").alias("bin")))
    base, weak = parts.where("kind < 3"), parts.where("kind >= 3")
    # a weak candidate within a base span is that one
    at = (F.col("start"), F.col("end"), kind)  # of equal spans base ones come first
    lo, hi = (Window.partitionBy("k1", "k2").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (at, [c.desc() for c in at]))
    marked = parts.withColumn("before", F.max(F.when(kind < 3, F.col("end"))).over(lo)).withColumn("after", F.min(F.when(kind < 3, F.col("start"))).over(hi))
    weak = marked.where((kind >= 3) & (F.coalesce(F.col("before") <= F.col("start"), F.lit(True))) & (F.coalesce(F.col("after") >= F.col("end"), F.lit(True))))
    bins = base.drop("bin").unionByName(weak.drop("before", "after", "bin")).withColumn("bin", F.expr(f"start div {SCOPE}")).groupBy("k1", "k2", "bin", "part").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    bins = bins.select("k1", "k2", F.col("bin").alias("near"), F.col("part").alias("other"), "first", "last")
    look = weak.select("k1", "k2", "kind", "start", "end", "part", "bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("near"))
    fit = ((F.col("part") == "secret") & (F.col("other") != "secret")) | ((F.col("part") != "secret") & (F.col("other") == "secret"))
    within = (F.col("last") >= F.col("start") - SCOPE) & (F.col("first") <= F.col("start") + SCOPE)
    linked = look.join(bins, ["k1", "k2", "near"]).where(fit & within).select("k1", "k2", "kind", "start", "end").distinct()
    every = base.select("k1", "k2", "kind", "start", "end").unionByName(linked)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)
    every = every.withColumn("span", F.struct("start", "kind", "end", F.concat_ws(":", name, "start", "end").alias("s")))
    spans = every.groupBy("k1", "k2").agg(*[F.count_if(kind == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.array_sort(F.collect_list("span")).alias("spans"))
    join = lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), ",")
    spans = spans.select("k1", "k2", *[f"n_{k}" for k in KINDS[:3]], join(F.filter("spans", lambda x: x["kind"] < 3)).alias("base"), join(F.col("spans")).alias("spans"))
    out = d.select("doc_id", "k1", "k2").join(spans, ["k1", "k2"], "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _oracle() -> str:
    """The same in DuckDB's SQL.  Its patterns cannot look behind, so those of hosts take in the character before, a line feed at the text's start."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "secret": SECRET, "endpoint": URL + r"|[^a-z0-9.-][a-z0-9.-]+:[0-9]+"}
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    rows = " UNION ALL ".join(
        f"""SELECT r, {i} AS kind, '{k}' AS name, unnest(list_transform(range(1, len(m) + 1), lambda j: struct_pack(m := m[j], s := list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0)))) AS x
        FROM (SELECT r, regexp_extract_all(t, '{quoted[k]}') AS m, string_split_regex(t, '{quoted[k]}') AS g FROM (SELECT r, {"chr(10) || text" if k == "endpoint" else "text"} AS t FROM d) WHERE regexp_matches(t, '{quoted[k]}'))"""
        for i, k in enumerate(KINDS)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
raw AS (SELECT r, kind, name, x.m AS m, x.s - (kind = 5)::INT AS s, (kind = 5 AND x.m[1] <> 'h')::INT AS lead FROM ({rows})),
found AS (SELECT r, kind, name, substr(m, 1 + lead) AS m, s + lead AS s, s + length(m) AS e, split_part(substr(m, 1 + lead), ':', 1) AS host FROM raw),
fit AS (
  SELECT *, CASE WHEN kind IN (1, 3) THEN 'id' WHEN kind = 5 THEN 'end' ELSE 'secret' END AS part FROM found
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(m, '{quoted["assign"]}', 2)) >= {LEAST_ASSIGNED} WHEN 4 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    WHEN 5 THEN contains(m, '://') OR contains(host, '.') AND NOT contains(host, '..') AND host[1] <> '.' AND host[-1] <> '.' AND length(split_part(m, ':', -1)) BETWEEN 2 AND 5 ELSE true END),
parts AS (SELECT * FROM fit f WHERE kind < 3 OR NOT EXISTS (FROM fit b WHERE b.r = f.r AND b.kind < 3 AND b.s < f.e AND f.s < b.e)),
spans AS (SELECT * FROM parts p WHERE kind < 3 OR EXISTS (FROM parts o WHERE o.r = p.r AND (o.part = 'secret') <> (p.part = 'secret') AND abs(o.s - p.s) <= {SCOPE})),
agg AS (
  SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS every
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN agg USING (r)
"""


ORACLE = _oracle()
