"""Quality rules, line first: failing lines go, then documents that lose too much text.

Words are runs other than ASCII white space.  A line fails if one of these rules holds for it:

* symbols: half as many of ``# * $ % & | < >`` as words, or more;
* capitals: five words or more, and letters, but no lower-case one;
* navigation: a fifth of its words or more are separators only, or it has at most
  ``LABEL_WORDS`` words and no mark of a sentence;
* boilerplate: fewer than ``PHRASE_WORDS`` words and one of the fixed phrases;
* repetition: eight words or more, fewer than two fifths of them distinct;
* punctuation: forty words or more without any mark of a sentence.

A document is kept if the base rules hold (``n_words >= 20`` and at most 30 in a hundred of its words in 8-word windows
found twice or more) and its failing lines have at most ``LOSS_PERCENT`` in a hundred of its words.

``judge`` returns one row per row of the input: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
base_failed, kept, n_failed_lines``, and with ``text=True`` also ``text``, without the failing lines.  A null or empty text
has no words and is not kept.  All is decided row by row, so ties, repeated rows and null ids need no care;
further columns are ignored.  Everything is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm._shared import own_columns

LEAST_WORDS, REPEAT_PERCENT, WINDOW, LOSS_PERCENT, LABEL_WORDS, PHRASE_WORDS = 20, 30, 8, 50, 4, 25
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\v\f\r"
#: Symbols, words that are separators only, marks of a sentence, and phrases of boilerplate in lower case.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "||", "»", "›", ">", ">>", "·", "•", "/", "-", "–", "::")
MARKS = ".,;:!?…\"'”’)"
PHRASES = ("all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript", "copyright ©")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _minus(text: Column, marks: str) -> Column:
    """How many characters of the text are among the marks."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _joined(xs: str, step: int) -> Column:
    """Hashes of each element with the one ``step`` after it."""
    n = F.greatest(F.size(xs) - step, F.lit(0))
    return F.zip_with(F.slice(xs, 1, n), F.slice(xs, step + 1, n), lambda a, b: F.xxhash64(a, b))


def with_repeat_words(d: DataFrame, w: str, out: str) -> DataFrame:
    """Adds how many words of the array ``w`` stand in windows of eight words found twice or more.

    Windows are hashed by doubling: pairs, pairs of pairs, pairs of those.  Only where they are not all distinct are
    they sorted with their places; the places of equal neighbours cover the words.  No step is more than a sort.
    """
    d = d.withColumn("_2", _joined(w, 1)).withColumn("_4", _joined("_2", 2)).withColumn("_8", _joined("_4", 4))
    d = d.withColumn("_again", F.size("_8") > F.size(F.array_distinct("_8")))
    d = d.withColumn("_s", F.when(F.col("_again"), F.array_sort(F.transform("_8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    n = F.size("_s") - 1
    same = F.filter(F.zip_with(F.slice("_s", 1, n), F.slice("_s", 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    places = F.array_sort(F.flatten(same))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(places, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    d = d.withColumn(out, F.coalesce(F.when(F.col("_again"), covered), F.lit(0)))
    return d.drop("_2", "_4", "_8", "_again", "_s")


def line_fails(line: Column, w: Column) -> Column:
    """Whether a line with the words ``w`` fails a rule."""
    n = F.size(w)
    symbols = 2 * _minus(line, SYMBOLS) >= n
    capitals = (n >= 5) & (F.upper(line) == line) & (F.lower(line) != line)
    separators = 5 * F.size(F.filter(w, lambda x: x.isin(*SEPARATORS))) >= n
    no_mark = (n <= LABEL_WORDS) | (n >= 40)
    no_mark = F.when(no_mark, _minus(line, MARKS) == 0).otherwise(False)
    phrase = F.when(n < PHRASE_WORDS, F.lower(line).rlike("|".join(PHRASES))).otherwise(False)
    repeated = (n >= 8) & (5 * F.size(F.array_distinct(w)) < 2 * n)
    return (n > 0) & (symbols | capitals | separators | no_mark | phrase | repeated)


def judge(docs: DataFrame, text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """See the module.  ``carry``: further columns to return, in the struct ``row``."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry if c != "text"]) if carry else F.lit(None)
    d = own_columns(docs.withColumn("row", row) if carry else docs, "doc_id", "text", *["row"] * bool(carry)).withColumn("t", F.coalesce("text", F.lit("")))
    d = d.withColumn("w", words(F.col("t")))
    d = with_repeat_words(d, "w", "repeat").withColumn("n", F.size("w")).drop("w")
    split = F.transform(F.split("t", "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("w")))
    d = d.withColumn("split", split)
    d = d.withColumn("lines", F.transform("split", lambda x: F.struct(x["line"].alias("line"), F.size(x["w"]).alias("n"), line_fails(x["line"], x["w"]).alias("fails"))))
    d = d.withColumn("full", F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"]))
    lost = F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(x["fails"], x["n"]).otherwise(0))
    base_failed = (F.col("n") < LEAST_WORDS) | (100 * F.col("repeat").cast("long") > REPEAT_PERCENT * F.col("n").cast("long"))
    d = d.withColumn("base_failed", base_failed).withColumn("lost", lost)
    out = [
        F.col("doc_id"),
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        _minus(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.col("repeat").cast("long").alias("n_repeat_words"),
        F.col("base_failed"),
        (~F.col("base_failed") & (100 * F.col("lost").cast("long") <= LOSS_PERCENT * F.col("n").cast("long"))).alias("kept"),
        F.size(F.filter("lines", lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
    ]
    if text:
        out.append(F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("text"))
    return d.select(*out, *["row"] * bool(carry))



def sql(docs: str = "documents", text: bool = False) -> str:
    """The same in DuckDB's SQL over the relation ``docs``."""
    more = ", cleaned AS text" if text else ""
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS k FROM win) WHERE k > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY r),
ln AS (SELECT r, k, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w FROM (SELECT r, unnest(lines) AS x, generate_subscripts(lines, 1) AS k FROM w)),
f AS (
  SELECT r, k, x, len(w) AS n, len(w) > 0 AND (
    2 * (length(x) - length(translate(x, '#*$%&|<>', ''))) >= len(w)
    OR (len(w) >= 5 AND upper(x) = x AND lower(x) <> x)
    OR 5 * len(list_filter(w, lambda y: y IN ('|', '||', '»', '›', '>', '>>', '·', '•', '/', '-', '–', '::'))) >= len(w)
    OR ((len(w) <= 4 OR len(w) >= 40) AND length(x) = length(translate(x, '.,;:!?…"''”’)', '')))
    OR (len(w) < 25 AND regexp_matches(lower(x), 'all rights reserved|licensed under|released under the|terms of use|terms of service|privacy policy|cookie policy|use cookies|enable javascript|copyright ©'))
    OR (len(w) >= 8 AND 5 * len(list_distinct(w)) < 2 * len(w))) AS fails
  FROM ln),
g AS (SELECT r, coalesce(sum(n) FILTER (fails), 0) AS lost, count(*) FILTER (fails) AS n_failed, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS dup_lines, coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (NOT fails), '') AS cleaned FROM f GROUP BY r),
b AS (
  SELECT w.doc_id, len(w.w) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, dup_lines, coalesce(rep.n, 0) AS rep_n, lost, n_failed, cleaned
  FROM w JOIN g USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup_lines AS BIGINT) AS n_dup_lines,
  CAST(rep_n AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * rep_n > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * rep_n > 30 * n_words) AND 100 * lost <= 50 * n_words AS kept, CAST(n_failed AS BIGINT) AS n_failed_lines{more}
FROM b
"""


ORACLE = sql()
