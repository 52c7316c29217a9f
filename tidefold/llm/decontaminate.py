"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the ones of a fixed mask; words at its zeros may differ.  Seeds of
the benchmark items and of the documents are joined; around each hit the aligned words of
the document and the item are compared.  An item leaks into a document if some stretch of the alignment, at
least four fifths of it equal, has ``MATCHED`` equal words or more (for an item of fewer than ``MATCHED`` words: four
fifths of them).  Words are runs other than ASCII white space; A-Z count as a-z.

The masks depend on the item's length, and every alignment that leaks has a seed: that was counted over all placements of
the substitutions allowed, one for items of 5 to 9 words, two up to 14 and three up to 16.  A longer stretch of four fifths equal words holds
one of 12 to 16 words that is four fifths equal (or has up to 24 words, which were counted too).  So recall is 1, at
any length.  Items of fewer than ``LEAST`` words carry no passage that could be recognised and leak nowhere.  A null or
empty text has no seeds.

``leaks`` returns a row for each pair of a document and an item that leaks into it: ``doc_id, item_id,
n_matched, n_aligned, doc_word, item_word`` (the best stretch, and where it starts).  Repeated
rows count once.  Rows with a null id take part; their id stays null.  Further columns are ignored.

Before the join a bitmap of bounded size over the items' seeds sieves the documents' seeds where they are read, and a table
of fixed size says how far an item with a seed reaches before and behind it.  Of a document only the stretches around hits go
on, so that one without a passage sends nothing over the network.  Ids are joined first; words are attached once to each pair of
a stretch and an item, however many seeds and alignments they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import _words as W
from tidefold.llm._bits import among, bitmap, bits_for
from tidefold.llm._shared import Tables, own_columns
from tidefold.llm.ngram_join import digest

#: Masks by the least number of words of the items that they seek.
MASKS = {5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"), 10: ("111011", "11010011", "111001001"), 12: ("111011", "10010001101")}
MATCHED, LEAST, MISS, REACH_BITS = 13, 5, 4, 18

_PLACE = W.mix(np.arange(1, 65, dtype=np.uint64) << np.uint64(7)) | np.uint64(1)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each word at which it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), dtype=np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            out += h[k : n + k] * _PLACE[k]
    return W.mix(out)


def masks_for(n: int) -> tuple[str, ...]:
    """The masks under which an item of n words is sought."""
    return MASKS[max(k for k in MASKS if k <= n)] if n >= LEAST else ()


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item, item_pos, left): left: the words of the item from the seed's place on."""
    names = ["seed", "item", "item_pos", "left"]
    for batch in batches:
        for _, h in W.by_text(batch.column(0)):
            for mask in masks_for(len(h)):
                s = seeds(h, mask)
                yield pa.record_batch([pa.array(s.view(np.int64)), pa.array(np.full(len(s), digest(h))), pa.array(np.arange(len(s))), pa.array(len(h) - np.arange(len(s)))], names=names)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(digest(h), len(h), h.tobytes()) for _, h in W.by_text(batch.column(1))]
        n = [x[1] for x in rows]
        yield pa.record_batch([batch.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([x[2] for x in rows], pa.binary())], names=["item_id", "item", "n", "item_words"])


def reach(sought: DataFrame) -> np.ndarray:
    """For the first bits of a seed, how many words before it and from it on an item with such a seed has at most."""
    by = F.shiftrightunsigned("seed", 64 - REACH_BITS).alias("at")
    found = sought.groupBy(by).agg(F.max("item_pos").alias("before"), F.max("left").alias("left")).toArrow()  # 2**REACH_BITS rows at most
    out = np.zeros((2, 1 << REACH_BITS), np.int32)
    out[:, found["at"].to_numpy()] = found["before"].to_numpy(), found["left"].to_numpy()
    return out


def _regions(shared, masks: tuple[str, ...]):
    """Stretches of documents around seeds that may be an item's: their words, and the seeds with their places."""
    schema = pa.schema([("doc_id", pa.int64()), ("region", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), ("hits", pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, far = shared.value
        for batch in batches:
            out = []
            for i, h in W.by_text(batch.column(1)):
                found = []
                for mask in masks:
                    s = seeds(h, mask)
                    at = np.flatnonzero(among(s, on))
                    found.append((s[at], at))
                s, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if not len(at):
                    continue
                before, left = far[:, (s >> np.uint64(64 - REACH_BITS)).astype(np.int64)]
                begin, end = np.maximum(0, at - before), np.minimum(len(h), at + left)
                order = np.argsort(begin, kind="stable")
                s, at, begin, end = s[order], at[order], begin[order], np.maximum.accumulate(end[order])
                cuts = np.concatenate([[0], np.flatnonzero(begin[1:] > end[:-1]) + 1, [len(at)]])
                doc = batch.column(0)[i].as_py()
                for j, k in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    a = int(begin[j])
                    part = h[a : int(end[k - 1])]
                    key = digest(np.append(part, np.array([a, -1 if doc is None else doc], np.int64).view(np.uint64)))
                    out.append((doc, key, a, part.tobytes(), [{"seed": x, "pos": p} for x, p in zip(s[j:k].view(np.int64).tolist(), at[j:k].tolist(), strict=True)]))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run, "doc_id long, region long, start long, words binary, hits array<struct<seed: long, pos: long>>"


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal words, start, end) of the stretch with the most equal words of those whose sum, 1 for equal words and -MISS for others, is not negative."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISS))])
    # for each end, the first start from which the sum is not negative
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    count = np.concatenate([[0], np.cumsum(equal)])
    end = int(np.argmax(count - count[start]))
    at = np.flatnonzero(equal[start[end] : end]) + start[end]
    return (len(at), int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0, 0)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, item, start, shifts, words, item_words) to the alignments that leak."""
    names = ["doc_id", "item_id", "n_matched", "n_aligned", "doc_word", "item_word"]
    for batch in batches:
        out, rows = [], []
        for i in range(batch.num_rows):
            start = batch.column(2)[i].as_py()
            h, g = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
            for shift in batch.column(3)[i].as_py():
                # item word j stands at word j + shift of the document, j + shift - start of the stretch
                off = shift - start
                a, b = max(0, -off), min(len(g), len(h) - off)
                m, s, e = best_stretch(h[a + off : b + off] == g[a:b])
                if m >= min(MATCHED, -(-4 * len(g) // 5)):
                    rows.append(i)
                    out.append((m, e - s, a + s + shift, a + s))
        if out:
            at = pa.array(rows)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]], names=names)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    tables = Tables(spark, "decontaminate")
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = own_columns(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = tables.keep(items.mapInArrow(_item_words, "item_id long, item long, n long, item_words binary").where(F.col("n") >= LEAST))
    sought = tables.keep(items.select("text").mapInArrow(_item_seeds, "seed long, item long, item_pos long, left long").distinct())
    sizes = words.agg(F.collect_set(F.expr(f"CASE {' '.join(f'WHEN n >= {k} THEN {k}' for k in sorted(MASKS, reverse=True))} END")).alias("k")).first()["k"]
    on = bitmap(sought.select("seed"), bits_for(sought.count()))
    run, schema = _regions(spark.sparkContext.broadcast((on, reach(sought))), tuple(dict.fromkeys(m for k in sorted(sizes) for m in MASKS[k])))
    regions = tables.keep(docs.mapInArrow(run, schema))
    # one candidate for each alignment, however many seeds agree on it
    hits = regions.select("region", F.inline("hits")).distinct()
    met = hits.join(sought, "seed").groupBy("region", "item").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"))
    one = words.groupBy("item").agg(F.first("item_words").alias("item_words"))
    pairs = met.join(one, "item").join(regions.drop("hits"), "region").select("doc_id", "item", "start", "shifts", "words", "item_words")
    found = pairs.mapInArrow(_aligned, "doc_id long, item long, n_matched long, n_aligned long, doc_word long, item_word long")
    best = F.max(F.struct("n_matched", -F.col("n_aligned"), -F.col("doc_word"), -F.col("item_word"))).alias("b")
    best = found.groupBy("doc_id", "item").agg(best)
    by_item = words.select("item_id", "item").distinct()
    out = best.join(by_item, "item").select("doc_id", "item_id", "b.*").toDF("doc_id", "item_id", "n_matched", "n_aligned", "doc_word", "item_word")
    return out.select("doc_id", "item_id", "n_matched", *[(-F.col(c)).alias(c) for c in ("n_aligned", "doc_word", "item_word")])


def sql(docs: str = "documents") -> str:
    """The same in DuckDB's SQL over the relation ``docs``, without seeds: all alignments in which three words in a row are equal, two for items of
    five words.  Of the equal words that make a leak, so many always stand together."""
    words = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
WITH it AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {LEAST}),
iw AS (SELECT DISTINCT w, n, CASE WHEN n = 5 THEN 2 ELSE 3 END AS k FROM it),
dw AS (SELECT DISTINCT doc_id, w, len(w) AS n FROM (SELECT doc_id, {words} AS w FROM {docs}) WHERE len(w) > 0),
dg AS (SELECT row_number() OVER () AS r, doc_id, w, n FROM dw),
ds AS (SELECT r, p, k, w[p:p + k - 1] AS g FROM (SELECT r, w, k, unnest(range(1, n - k + 2)) AS p FROM dg, (SELECT DISTINCT k FROM iw) WHERE n >= k)),
si AS (SELECT w, p, k, w[p:p + k - 1] AS g FROM (SELECT w, k, unnest(range(1, n - k + 2)) AS p FROM iw)),
al AS (SELECT row_number() OVER () AS a, doc_id, dg.w AS x, m.w AS y, shift FROM (SELECT DISTINCT r, si.w, ds.p - si.p AS shift FROM ds JOIN si USING (k, g)) m JOIN dg USING (r)),
eq AS (SELECT a, j, coalesce(x[j + shift + 1] = y[j + 1], false) AS same FROM (SELECT a, x, y, shift, unnest(range(greatest(0, -shift), least(len(y), len(x) - shift))) AS j FROM al)),
pr AS (SELECT a, j, same, sum(CASE WHEN same THEN 1 ELSE -{MISS} END) OVER u AS t, count(*) FILTER (same) OVER u AS c FROM eq WINDOW u AS (PARTITION BY a ORDER BY j)),
ends AS (SELECT a, j + 1 AS j, t, c FROM pr UNION ALL SELECT a, min(j), 0, 0 FROM pr GROUP BY a),
st AS (SELECT e.a, e.c - s.c AS m, e.j AS e, s.j AS s FROM ends e JOIN ends s ON e.a = s.a AND s.j < e.j AND e.t >= s.t),
be AS (SELECT a, m, e, s FROM st QUALIFY row_number() OVER (PARTITION BY a ORDER BY m DESC, e, s) = 1),
tr AS (SELECT be.a, any_value(m) AS m, min(j) AS lo, max(j) + 1 AS hi FROM be JOIN eq ON eq.a = be.a AND same AND j >= s AND j < e GROUP BY be.a),
lk AS (SELECT doc_id, y, m, hi - lo AS n, lo + shift AS dw, lo AS iw FROM tr JOIN al USING (a) WHERE m >= least({MATCHED}, (4 * len(y) + 4) // 5)),
one AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY doc_id, y ORDER BY m DESC, n, dw, iw) = 1)
SELECT DISTINCT doc_id, item_id, CAST(m AS BIGINT) AS n_matched, CAST(one.n AS BIGINT) AS n_aligned, CAST(dw AS BIGINT) AS doc_word, CAST(iw AS BIGINT) AS item_word
FROM one JOIN it ON it.w = one.y
"""


ORACLE = sql()
