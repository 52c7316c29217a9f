"""N-gram Jaccard join: rare-first prefix filtering with length and positional filters and a bitmap signature bound.

Two documents link when the Jaccard similarity of their sets of word shingles is at
least ``percent`` in a hundred.  Shingles are 64-bit hashes and equal sets are told by their size and 128 bits of digest;
but for that every step is exact.  The only estimate is the order of the shingles, and any order gives the same links.

1. One pass over the texts gives the set's size and a digest of each document, and
   adds up a count sketch of all shingles (``2**SKETCH_BITS`` counters, a fixed size).
   Documents with equal sets form a class; only its first document goes on.
2. Each set is ordered rare-first by the sketch.  If two sets link, their prefixes of
   ``n - ceil(percent * n / 100) + 1`` shingles share one.  Prefix entries are dealt by
   shingle and sorted by position.  In each shingle's bucket the first entry, whose
   document has the fewest rare shingles and thus is the most central of a group of
   near copies, is compared with the others: a group of any size costs its size.
3. Pairs that pass the length and positional filters are sieved by a bound from bitmaps of about a bit for
   each shingle of the whole sets, which stands in for a suffix filter, and verified once on the whole sets.  Connected components over the links follow.
4. Entries of one bucket that are still in different components are compared if their sizes lie in the same or neighbouring bands
   (each as wide as the threshold lets two sizes differ, so that a bucket is split by length before it is paired) and three
   filters let them: the positional filter, tightened by the count of shared shingles so far;
   the count of prefix shingles that the pair shares; and the pivot bound.  If both x and y were compared
   with the bucket's first document (in buckets of ``MANY`` entries all are, whatever the filters said) and their shingles outside it counted, the overlap of x and y is
   at most the smaller of their overlaps with the first document and the smaller of the numbers of
   shingles of x outside that document which another one so counted has too.  So the
   members of a group of near misses, each with changes of its own, need not be compared in pairs.
   Pairs within a component need no comparison.

Result: one row per row of the input: ``doc_id, n_shingles, component_id``.
``component_id`` is the smallest ``doc_id`` reachable by links.  A null or empty text has
no shingles and is linked with nothing.  A row whose ``doc_id`` is null keeps its size and
has a null ``component_id``.  Rows that repeat a ``doc_id`` are copies of one vertex if their texts
agree; if not, the vertex has the links of all of them.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm import _words as W
from tidefold.llm._bits import among, bitmap, bits_for
from tidefold.llm._shared import Tables, components, own_columns

WIDTH, PERCENT = 5, 80
#: A sketch has 2**SKETCH_BITS counters and travels in packed pieces of 2**PIECE_BITS.
SKETCH_BITS, PIECE_BITS = 22, 16
#: A bucket with so many entries gives all of them a pivot bound.
MANY = 16
#: Texts or pairs of sets that a Python worker holds at once.
TEXTS, SETS = 1000, 200
#: Pairs whose whole sets are shuffled at once, or a quarter of the documents if that is more.
PAIRS = 100_000


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _second(s: np.ndarray) -> int:
    """A digest that has nothing in common with the first."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8, person=b"second").digest(), "little", signed=True)


def signature(s: np.ndarray) -> np.ndarray:
    """A bitmap of the set's hashes, of a power of two of bits: as many as shingles, up to twice as many, at least 64."""
    m = max(64, 1 << (len(s) - 1).bit_length())
    on = np.zeros(m // 64, dtype=np.uint64)
    bit = s & np.uint64(m - 1)
    np.bitwise_or.at(on, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return on


def at_most(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """A bound of the overlap of two sets of n and m shingles by their signatures."""
    while len(x) != len(y):
        x, y = (x[: len(x) // 2] | x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] | y[len(y) // 2 :])
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def pieces(sums: Iterator[tuple[int, np.ndarray]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Numbered pieces of a sketch as (number, bytes of a counter, packed counters); those without a count are left out."""
    at, width, packed = [], [], []
    for k, c in sums:
        if most := int(c.max()):
            c = c.astype(np.min_scalar_type(most))
            at.append(k)
            width.append(c.itemsize)
            packed.append(zlib.compress(c.tobytes(), 1))
    return pa.array(at, pa.int64()), pa.array(width, pa.int64()), pa.array(packed, pa.binary())


def unpacked(width: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), f"u{width}")


def _added():
    """Pieces with the same number to their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, width, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = unpacked(width, packed)
                if k in sums:
                    sums[k] += c
                else:
                    sums[k] = c.astype(np.int64)
        yield pa.record_batch(list(pieces(iter(sums.items()))), names=["at", "width", "packed"])

    return run, "at long, width long, packed binary"


def _sketch(parts: DataFrame, tables: Tables, bits: int) -> np.ndarray:
    """The sum of the tasks' sketches in 16 bits a counter: their low bits go when counters are large, and what is over 16 bits ties."""
    run, schema = _added()
    sums = parts.mapInArrow(run, schema).repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at").mapInArrow(run, schema)
    counts = np.zeros(1 << bits, dtype=np.int64)
    for batch in (found := tables.keep(sums, 64)).toArrow().to_batches():
        for k, width, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts[k << PIECE_BITS : (k + 1) << PIECE_BITS] = unpacked(width, packed)
    tables.drop(found)
    counts >>= max(0, int(counts.mean()).bit_length() - 13)
    return np.minimum(counts, (1 << 16) - 1).astype(np.uint16)


def _sizes(width: int, bits: int):
    """Kind 0: (doc_id, n, both digests, signature) of each row; kind 1: a piece of the task's sketch in (doc_id, n, -, -, signature)."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("node2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            n, node, node2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            sig = [b""] * batch.num_rows
            for i, h in W.by_text(batch.column(1)):
                s = W.shingle_set(h, width)
                if len(s):
                    n[i], node[i], node2[i], sig[i] = len(s), digest(s), _second(s), signature(s).tobytes()
                    np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int8)), batch.column(0), pa.array(n), pa.array(node), pa.array(node2), pa.array(sig, pa.binary())], schema=schema)
        at, size, packed = pieces(enumerate(counts.reshape(-1, 1 << PIECE_BITS)))
        yield pa.record_batch([pa.array(np.ones(len(at), np.int8)), at, size, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), packed], schema=schema)

    return run, "kind tinyint, doc_id long, n long, node long, node2 long, sig binary"


def _prefixes(width: int, percent: int, bits: int, sketch):
    """The rare-first prefix of every set; sets that the task has seen before are left out."""
    schema = pa.schema([("token", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a class that a task meets twice needs no second prefix; one that is left out here by the digest alone has the size too
        counts, seen, out, held = sketch.value, set(), [], 0

        def full() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

        for batch in batches:
            ids = batch.column(0)
            for i, h in W.by_text(batch.column(1)):
                s = W.shingle_set(h, width)
                if not len(s) or not ids[i].is_valid or (key := (len(s), digest(s), _second(s))) in seen:
                    continue
                seen.add(key)
                n = len(s)
                p = n - (percent * n + 99) // 100 + 1
                # counts and hashes in one key: the count in the high bits, ties by the hash
                c = counts[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
                order = np.argsort((c << np.uint64(24)) | (s & np.uint64((1 << 24) - 1)), kind="stable")[:p]
                out.append((s[order].view(np.int64), (np.arange(p, dtype=np.int64) << 32) | n, np.full(p, ids[i].as_py(), np.int64)))
                held += p
                if held > 100_000:
                    yield full()
                    out, held = [], 0
        if out:
            yield full()

    return run, "token long, place long, doc_id long"


def _pivots(percent: int):
    """Sorted prefix entries to those of buckets with two documents or more, each with its bucket's first entry."""
    schema = pa.schema([("token", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("lead", pa.bool_()), ("with_doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of the bucket at the end of the batch before: its first entry, and if that has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            token, place, doc = (batch.column(k).to_numpy() for k in range(3))
            shown = np.zeros(len(token), bool)
            if last is not None:
                token, place, doc, shown = (np.concatenate([[x], y]) for x, y in zip(last, (token, place, doc, shown), strict=True))
                token, place, doc, shown = token.astype(np.int64), place.astype(np.int64), doc.astype(np.int64), shown.astype(bool)
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            start = np.flatnonzero(new)
            many = np.diff(np.append(start, len(token)))
            first = np.repeat(start, many)
            live = np.repeat(many > 1, many) & ~shown
            pos, n = place >> 32, place & 0xFFFFFFFF
            pn, low = n[first], np.minimum(n, n[first])
            need = -(-percent * (n + pn) // (100 + percent))
            most = np.minimum(pos, pos[first]) + 1 + np.minimum(n - pos, pn - pos[first]) - 1
            fits = (first != np.arange(len(n))) & (100 * low >= percent * np.maximum(n, pn)) & (most >= need) & (doc != doc[first])
            with_doc = pa.array(doc[first], mask=~fits)
            keep = np.flatnonzero(live)
            at = start[-1]
            last = (token[at], place[at], doc[at], bool(shown[at] or many[-1] > 1))
            if len(keep):
                yield pa.record_batch([pa.array(token[keep]), pa.array(pos[keep]), pa.array(n[keep]), pa.array(doc[keep]), pa.array(first[keep] == keep), with_doc.take(pa.array(keep))], schema=schema)

    return run, "token long, pos long, n long, doc_id long, lead boolean, with_doc long"


def _sets(width: int, wanted):
    """The whole sets of the documents whose bit is on."""
    schema = pa.schema([("doc_id", pa.int64()), ("s", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = among(batch.column(2).to_numpy().view(np.uint64), wanted.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            rows = pa.array(np.flatnonzero(hit))
            ids, got, at, held = batch.column(0).take(rows), [], [], 0
            for i, h in W.by_text(batch.column(1).take(rows)):
                got.append(W.shingle_set(h, width).tobytes())
                at.append(ids[i].as_py())
                held += len(got[-1])
                if held > 4_000_000:
                    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(got, pa.large_binary())], schema=schema)
                    got, at, held = [], [], 0
            if got:
                yield pa.record_batch([pa.array(at, pa.int64()), pa.array(got, pa.large_binary())], schema=schema)

    return run, "doc_id long, s binary"


def overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the ascending set y are in the ascending set x."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return x[at] == y


def _verify(percent: int, outside: float):
    """(a, b, n, o, linked, outside): the size of b, the overlap, and the shingles of b that a lacks if they are at most that share of b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("o", pa.int64()), ("linked", pa.bool_()), ("outside", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, o, linked, out = [], [], [], []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (s, t))
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                common = overlap(x, y)
                n.append(len(y))
                o.append(int(common.sum()))
                linked.append(o[-1] >= need)
                out.append(y[~common].view(np.int64) if outside and len(y) - o[-1] <= outside * len(y) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(o, pa.int64()), pa.array(linked, pa.bool_()), pa.array(out, pa.list_(pa.int64()))], schema=schema)

    return run, "a long, b long, n long, o long, linked boolean, outside array<long>"


def _sieve(percent: int):
    """(a, b, n, m, x, y) with signatures x and y to the pairs that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, m) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if 100 * min(n, m) >= percent * max(n, m):
                    x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint64) for k in (4, 5))
                    if at_most(x, y, n, m) >= -(-percent * (n + m) // (100 + percent)):
                        keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    return run, "a long, b long"


def _sieved(pairs: DataFrame, sigs: DataFrame, tables: Tables, percent: int) -> DataFrame:
    left = pairs.join(sigs.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("sig").alias("y")), "b")
    both = left.join(sigs.select(F.col("rep").alias("a"), "n", F.col("sig").alias("x")), "a").select("a", "b", "n", "m", "x", "y")
    run, schema = _sieve(percent)
    return tables.keep(both.mapInArrow(run, schema).distinct())


def _verified(docs: DataFrame, pairs: DataFrame, tables: Tables, width: int, percent: int, outside: float, most: int) -> DataFrame:
    """The distinct pairs (a, b) with their overlaps; about ``most`` at once, since their sets may take many times the disk of the input."""
    parts = max(1, math.ceil(pairs.count() / most))
    own = [pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [pairs]
    return reduce(DataFrame.unionByName, [_verified_at_once(docs, some, tables, width, percent, outside) for some in own])


def _verified_at_once(docs: DataFrame, pairs: DataFrame, tables: Tables, width: int, percent: int, outside: float) -> DataFrame:
    # a bitmap of bounded size keeps most other sets out of the shuffle; the joins below are exact
    on = bitmap(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b")))), bits_for(2 * pairs.count()))
    run, schema = _sets(width, docs.sparkSession.sparkContext.broadcast(on))
    sets = docs.select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(run, schema)
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("t")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), "s"), "a").select("a", "b", "s", "t")
    run, schema = _verify(percent, outside)
    return tables.keep(both.mapInArrow(run, schema), SETS)


def _need(n, m, percent: int):
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def _band(n, percent: int):
    """Bands of sizes: two that may link are in the same one or in neighbours, with a hundredth to spare for rounding."""
    return F.floor(F.log(n.cast("double")) / max(1e-3, 1.01 * math.log(100 / percent)))


def similarity_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text, ...)``; see the module."""
    spark = docs.sparkSession
    tables = Tables(spark, "ngram-join", lean=True)
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, schema = _sizes(width, SKETCH_BITS)
    both = tables.keep(docs.mapInArrow(run, schema), TEXTS)
    sizes = both.where("kind = 0").drop("kind")
    counts = _sketch(both.where("kind = 1").select("doc_id", "n", "sig"), tables, SKETCH_BITS)
    some = sizes.where("n > 0")
    # classes of one are most; the others are written first, so that the join with a class of very many rows can be split
    classes = tables.keep(some.groupBy("node", "node2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"))
    vertices = tables.keep(some.drop("sig").join(classes, ["node", "node2", "n"], "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("rep")))
    sigs = some.join(vertices.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", "sig")
    of = vertices.where("doc_id is not null").select("doc_id", "rep").distinct()
    most = max(PAIRS, vertices.count() // 4)

    run, schema = _prefixes(width, percent, SKETCH_BITS, spark.sparkContext.broadcast(counts))
    entries = docs.mapInArrow(run, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token").sortWithinPartitions("token", "place", "doc_id")
    run, schema = _pivots(percent)
    live = tables.keep(entries.mapInArrow(run, schema), 3 * TEXTS)

    # a is the bucket's first document; a pair that meets both ways is verified one way
    named = live.where("with_doc is not null").select(F.col("with_doc").alias("a"), F.col("doc_id").alias("b")).distinct()
    named = named.join(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b").where("ra <> rb")
    first = named.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.min("ra").alias("a"))
    first = tables.keep(first.select("a", F.when(F.col("x") == F.col("a"), F.col("y")).otherwise(F.col("x")).alias("b")))
    met = _verified(docs, _sieved(first, sigs, tables, percent), tables, width, percent, outside=0.5, most=most)
    # an id with several texts is one vertex
    split = of.groupBy("doc_id").agg(F.min("rep").alias("b"), F.count("*").alias("k")).where("k > 1").drop("k")
    again = of.join(split, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    one = tables.keep(components(met.where("linked").select("a", "b").unionByName(again), tables))

    label = of.join(one, of["rep"] == one["id"], "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("comp"))
    # tasks leave out only the copies that they have seen themselves: one document speaks for its class, but for ids with several texts
    speaks = live.select("doc_id").distinct().join(of, "doc_id").join(split, "doc_id", "left_anti").groupBy("rep").agg(F.min("doc_id").alias("doc_id"))
    speaks = tables.keep(speaks.select("doc_id").unionByName(split.select("doc_id")))
    rest = live.where("not lead").select("token", "doc_id", "pos", "n").join(speaks, "doc_id", "left_semi").join(label, "doc_id")
    # an id with several texts leads without a bound
    leads = live.where("lead").join(of, "doc_id").groupBy("token").agg(F.when(F.count("*") == 1, F.min("rep")).alias("first"))
    open_ = rest.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).where("c0 <> c1").select("token", "m")
    # copies of a bucket's first document have been compared with it
    rest = rest.join(open_.join(leads, "token"), "token").where("first is null or rep <> first").withColumn("before", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    rest = tables.keep(rest)

    # the pivot bound: what b can share, in a and outside of it, with another document that has a bound under a; one without may share more.  An id with
    # several texts has several rows for a pair, and a bound only if the outside of each is known
    counted = met.join(met.groupBy("a", "b").agg(F.bool_and(F.col("outside").isNotNull()).alias("all")).where("all").select("a", "b"), ["a", "b"], "left_semi")
    # in large buckets the filters that kept a document from its first one do not say what it shares with the others
    asked = rest.where(F.col("m") >= MANY).select(F.col("first").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct().join(counted, ["a", "b"], "left_anti")
    asked = tables.keep(asked)
    if not asked.isEmpty():
        counted = counted.unionByName(_verified(docs, asked, tables, width, percent, outside=0.5, most=most).where("outside is not null"))
    near = tables.keep(counted.where("not linked").select("a").distinct())
    outer = counted.join(near, "a", "left_semi").select("a", "b", F.explode("outside").alias("t"))
    common = outer.groupBy("a", "t").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    extra = outer.join(common, ["a", "t"]).groupBy("a", "b").agg(F.count("*").alias("k"))
    whole = counted.join(near, "a", "left_semi").groupBy("a", "b").agg(F.max("o").alias("o"))
    bound = whole.join(extra, ["a", "b"], "left").select(F.col("a").alias("first"), F.col("b").alias("rep"), F.col("o").alias("shared"), F.coalesce("k", F.lit(0)).alias("extra"))
    entries, rest = rest, tables.keep(rest.drop("m").join(bound, ["first", "rep"], "left").withColumn("first", F.when(F.col("shared").isNotNull(), F.col("first"))))
    x, y = (rest.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "rep", "comp", "pos", "n", "before", "first", "shared", "extra")]) for k in "xy")
    need = _need(F.col("n_x"), F.col("n_y"), percent)
    apart = F.coalesce((F.col("first_x") == F.col("first_y")) & (F.least("shared_x", "shared_y") + F.least("extra_x", "extra_y") < need), F.lit(False))
    may = ~apart & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (F.least("before_x", "before_y") + 1 + F.least(F.expr("n_x - pos_x - 1"), F.expr("n_y - pos_y - 1")) >= need)
    # x is in the lower band, or in the same one the lower document
    x, y = x.withColumn("band", _band(F.col("n_x"), percent)), y.withColumn("band_y", _band(F.col("n_y"), percent))
    y = y.withColumn("band", F.explode(F.array("band_y", F.col("band_y") - 1)))
    pairs = x.join(y, ["token", "band"]).where("(band < band_y or rep_x < rep_y) and comp_x <> comp_y").where(may)
    pairs = pairs.groupBy("rep_x", "rep_y", "doc_id_x", "doc_id_y").agg(F.count("*").alias("c"), F.max("pos_x").alias("p"), F.max("pos_y").alias("q"), F.first("n_x").alias("n"), F.first("n_y").alias("m"))
    pairs = pairs.where(F.col("c") + F.least(F.expr("n - p - 1"), F.expr("m - q - 1")) >= _need(F.col("n"), F.col("m"), percent))
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = tables.keep(pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct().join(known, ["a", "b"], "left_anti"))
    by_rep = label.select(F.col("rep").alias("id"), "comp").distinct()
    if second.isEmpty():
        last = by_rep
    else:
        more = _verified(docs, _sieved(second, sigs, tables, percent), tables, width, percent, outside=0, most=most).where("linked")
        joined = more.join(by_rep.select(F.col("id").alias("a"), F.col("comp").alias("u")), "a").join(by_rep.select(F.col("id").alias("b"), F.col("comp").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
        two = components(joined, tables).select(F.col("id").alias("comp"), "component")
        last = by_rep.join(two, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp"))
    last = tables.keep(last)
    tables.drop(live, entries, rest, first, second, met)
    out = vertices.join(last.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("comp")).alias("component_id"))
    return out.unionByName(sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def sql(docs: str = "documents") -> str:
    """The same in DuckDB's SQL over the relation ``docs``."""
    return rf"""
WITH RECURSIVE
w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM {docs}),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id
FROM {docs} d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id l ON l.a = d.doc_id
"""


ORACLE = sql()
