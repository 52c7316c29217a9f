"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources in code-point order, null last, weigh ``weights`` in turn and share the corpus' words; no target is above
``most`` times its source's size, and what is above goes to the others by weight.  With
blocks of ``block`` words, the mix has as many blocks as its words make, rounded, and they go to the sources with the highest quotients
target / (2k - 1) for the k-th block: that is Sainte-Laguë's allocation.  A source's documents are dealt
to shards of about ``shard_words`` words by a seeded hash of the row; each shard's stream of words is cut into blocks of equal
length, and the source's blocks are apportioned to its shards in the same way.
A quota of f times the shard's blocks and r more takes every word f times, and r blocks that a seeded
permutation picks once more.

``mix`` returns one row per row of the input: ``doc_id, size, source_size, target, taken``.  ``size`` is the number of
words; a null text has none.  ``taken`` counts the words the mix takes, repeats included, at most ``most``
times the size.  Null ids, repeated rows and ties are dealt by what the row holds, so reruns agree; rows alike in id and text are in one shard.
An empty corpus gives no rows; a corpus without words takes nothing.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm._shared import WORD, Tables, own_columns

WEIGHTS, MOST, SEED, SHARD_WORDS = (5, 2, 1), 3, 17, 1 << 20
#: Primes below 2**31, multipliers of permutations of fewer blocks than that.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)


def _dice(*parts) -> Column:
    """A seeded number of 60 bits that other engines can compute too: the first digits of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit("null")) if isinstance(x, str) else F.lit(x) for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, column: str, tables: Tables) -> DataFrame:
    """``df`` with ``rank`` from 0 in the order of a distinct column, null last; no task gets all rows."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    order = F.col(column).asc_nulls_last()
    dealt = tables.keep(df.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").count().collect()  # a row for each partition
    before, start = 0, {}
    for r in sorted(counts):
        start[r["part"]], before = before, before + r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("part")) if start else F.lit(0)
    return dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + offset).drop("part")


def targets(sizes: DataFrame, tables: Tables, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int, int]:
    """``source, source_size, rank, weight, target`` of each source; all words; the number of sources."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = tables.keep(ranked(sources, "source", tables).withColumn("weight", w))
    total, n, all_weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*"), F.coalesce(F.sum("weight"), F.lit(1))).first()
    share, full = total / all_weight, 0
    while True:
        at = F.col("source_size") * most < F.col("weight") * F.lit(share)
        k, held, left = sources.agg(F.count_if(at), F.coalesce(F.sum(F.when(at, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~at, F.col("weight"))), F.lit(0))).first()
        if k == full or not left:
            break
        full, share = k, (total - held) / left
    target = F.least(F.col("weight") * F.lit(float(share)), (F.col("source_size") * most).cast("double"))
    return sources.withColumn("target", target), total, n


def apportioned(claims: DataFrame, group: str, x: str, tie: str) -> DataFrame:
    """``claims`` with ``q``: how many of a group's seats, its claims ``x`` added up and rounded, Sainte-Laguë's method gives each.

    Each claim rounded is the allocation for another number of seats, so only the difference is dealt, by highest quotients.  With S
    claims of sum X the multiplier that leads to the right number is within (S + 1) / 2X of 1, which bounds the seats that any one claim may gain
    or lose: altogether there are fewer candidates than three for each claim.
    """
    whole = Window.partitionBy(group)
    c = claims.withColumn("q", F.floor(F.col(x) + 0.5)).withColumn("millionths", F.floor(F.col(x) * 1_000_000 + 0.5))  # whole numbers add up alike in any order
    c = c.withColumn("all", F.sum("millionths").over(whole)).withColumn("over", F.expr("(all + 500000) div 1000000") - F.sum("q").over(whole))
    most = F.ceil(F.col(x) * (F.count("*").over(whole) + 1) * 500_000 / F.col("all")) + 1
    c = c.withColumn("most", F.when((F.col("over") != 0) & (F.col("all") > 0), F.least(F.abs("over"), most)))
    columns = [k for k in c.columns if k not in ("millionths", "all", "most")]
    c = c.select(*columns, F.explode_outer(F.when(F.col("most") > 0, F.sequence(F.lit(1).cast("long"), F.col("most")))).alias("j"))
    gain = F.when(F.col("over") > 0, F.col(x) / (2 * (F.col("q") + F.col("j")) - 1)).when(F.col("q") >= F.col("j"), -F.col(x) / (2 * (F.col("q") - F.col("j")) + 1))
    place = F.row_number().over(whole.orderBy(F.when(F.col("j").isNotNull(), gain).desc_nulls_last(), tie, "j"))
    c = c.withColumn("gains", (F.col("j").isNotNull() & (place <= F.abs("over"))).cast("long"))
    c = c.groupBy(*columns).agg(F.sum("gains").alias("gains"))
    return c.withColumn("q", F.col("q") + F.signum("over").cast("long") * F.col("gains")).drop("over", "gains")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, shard_words: int = SHARD_WORDS, block: int | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken``; see the module.  ``block`` is by default a two-thousandth of a source's mean size, 1 to 1024 words."""
    tables = Tables(docs.sparkSession, "mixing")
    slim = own_columns(docs, "doc_id", "source", "text")
    slim = slim.withColumn("own", F.md5("text"))
    sizes = tables.keep(slim.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _dice(seed, "doc_id", "own").alias("dice")))
    sources, total, n = targets(sizes, tables, weights, most)
    block = block or min(1024, max(1, total // (2000 * max(1, n))))
    sources = tables.keep(apportioned(sources.withColumn("claim", F.col("target") / block).withColumn("g", F.lit(0)), "g", "claim", "rank").drop("g", "claim"))
    sources = sources.withColumn("ratio", F.when(F.col("source_size") > 0, F.least(F.col("q") * block / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))
    sources = sources.withColumn("shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words))
    dealt = sizes.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    dealt = dealt.withColumn("shard", F.col("dice") % F.col("shards"))
    dealt = dealt.select("doc_id", "size", "source_size", "target", "ratio", "rank", "shard", "dice")

    shards = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("ratio").alias("ratio"))
    shards = shards.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / block)))
    shards = apportioned(shards.withColumn("ideal", F.col("ratio") * F.col("blocks")), "rank", "ideal", "shard")
    shards = shards.withColumn("q", F.greatest(F.lit(0), F.least("q", F.col("blocks") * most)))
    turn = _dice(seed, "rank", "shard")
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (turn % len(PRIMES) + 1).cast("int")).cast("long")
    shards = tables.keep(shards.select("rank", "shard", "words", "blocks", (F.expr("q div blocks")).alias("full"), (F.col("q") % F.col("blocks")).alias("extra"), prime.alias("prime"), (turn % F.col("blocks")).alias("first")))

    stream = Window.partitionBy("rank", "shard").orderBy("dice", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum("size").over(stream)).withColumn("at", F.col("end") - F.col("size"))
    placed = placed.join(shards, ["rank", "shard"])
    extra = F.expr(
        """aggregate(sequence(((at + 1) * blocks - 1) div words, (end * blocks - 1) div words), 0L, (sum, j) ->
            sum + if((j * prime + first) % blocks < extra, least(end, (j + 1) * words div blocks) - greatest(at, j * words div blocks), 0L))"""
    )
    taken = F.when(F.col("size") > 0, F.col("full") * F.col("size") + F.when(F.col("extra") > 0, extra).otherwise(0)).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def sql(docs: str = "documents") -> str:
    """The same in DuckDB's SQL, with the default parameters, over the relation ``docs``."""

    def seats(name: str, claims: str, x: str, group: str, tie: str) -> str:
        """CTEs that end in ``name``: the relation ``claims`` with its seats in ``q``."""
        return f"""
{name}1 AS (SELECT *, CAST(floor({x} + 0.5) AS BIGINT) AS q0, CAST(sum(CAST(floor({x} * 1000000 + 0.5) AS BIGINT)) OVER g AS BIGINT) AS whole_, count(*) OVER g AS s_ FROM {claims} WINDOW g AS (PARTITION BY {group})),
{name}2 AS (SELECT *, (whole_ + 500000) // 1000000 - CAST(sum(q0) OVER (PARTITION BY {group}) AS BIGINT) AS over_ FROM {name}1),
{name}3 AS (SELECT {group} AS g, {tie} AS t, {x} AS x, q0, over_, unnest(range(1, least(abs(over_), CAST(ceil({x} * (s_ + 1) * 500000 / whole_) AS BIGINT) + 1) + 1)) AS j FROM {name}2 WHERE over_ <> 0 AND whole_ > 0),
{name}4 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN over_ > 0 THEN x / (2 * (q0 + j) - 1) WHEN q0 >= j THEN -x / (2 * (q0 - j) + 1) END DESC NULLS LAST, t, j) AS place FROM {name}3),
{name}5 AS (SELECT g, t, count(*) AS k FROM {name}4 WHERE place <= abs(over_) GROUP BY g, t),
{name} AS (SELECT c.*, c.q0 + sign(c.over_) * coalesce(k, 0) AS q FROM {name}2 c LEFT JOIN {name}5 p ON p.g = c.{group} AND p.t = c.{tie})"""

    return rf"""
WITH z AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS size, ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS dice FROM {docs}),
so AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM z GROUP BY source),
ra AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM so),
we AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ra),
tt AS (SELECT sum(n) AS total, greatest(1, least(1024, sum(n) // (2000 * count(*)))) AS block FROM so),
-- the sources that stop at their limit are the first k in the order of limit over weight
o AS (SELECT *, row_number() OVER (ORDER BY n::DOUBLE / w, rank) AS k FROM we),
c AS (SELECT k, n, w, coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
l AS (SELECT (total - held)::DOUBLE / free::DOUBLE AS share FROM c, tt WHERE 3 * n >= w * ((total - held)::DOUBLE / free::DOUBLE) ORDER BY k LIMIT 1),
ta AS (SELECT we.*, least(w * share, (3 * n)::DOUBLE) AS target, greatest(1, n) AS least_n FROM we, l),
cl AS (SELECT ta.*, target / block AS claim, 0 AS one FROM ta, tt),{seats("se", "cl", "claim", "one", "rank")},
st AS (SELECT se.*, CASE WHEN n > 0 THEN least(q * block / n, 3.0) ELSE 0 END AS ratio, CAST(ceil(least_n / {SHARD_WORDS}) AS BIGINT) AS shards FROM se, tt),
de AS (SELECT doc_id, size, n, target, ratio, rank, dice, shards FROM z JOIN st ON z.source IS NOT DISTINCT FROM st.source),
dd AS (SELECT *, dice % shards AS shard FROM de),
s1 AS (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS words, any_value(ratio) AS ratio FROM dd GROUP BY rank, shard),
s2 AS (SELECT *, CAST(greatest(1, ceil(words / block)) AS BIGINT) AS blocks FROM s1, tt),
s3 AS (SELECT *, ratio * blocks AS ideal FROM s2),{seats("s4", "s3", "ideal", "rank", "shard")},
s5 AS (SELECT rank, shard, words, blocks, CAST(greatest(0, least(q, 3 * blocks)) AS BIGINT) AS q,
  ('0x' || substr(md5('{SEED}:' || rank || ':' || shard), 1, 15))::BIGINT AS turn FROM s4),
s6 AS (SELECT *, q // blocks AS whole, q % blocks AS extra, [{", ".join(map(str, PRIMES))}][turn % {len(PRIMES)} + 1]::BIGINT AS prime, turn % blocks AS first_ FROM s5),
pl AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rank, shard ORDER BY dice, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e FROM dd),
po AS (SELECT *, e - size AS b FROM pl)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
  CAST(CASE WHEN size > 0 THEN whole * size + coalesce(list_sum(list_transform(range(((b + 1) * blocks - 1) // words, (e * blocks - 1) // words + 1),
    lambda j: CASE WHEN (j * prime + first_) % blocks < extra THEN least(e, (j + 1) * words // blocks) - greatest(b, j * words // blocks) ELSE 0 END)), 0) ELSE 0 END AS BIGINT) AS taken
FROM po JOIN s6 USING (rank, shard)
"""


ORACLE = sql()
