"""PostgreSQL's logical replication messages (pgoutput, protocol version 1) to change rows.

``Assembler`` turns an ordered stream of them into the change rows of whole
transactions; ``decode_log`` does that for stored segments of a stream, each of which begins outside a transaction
and announces the relations that it uses.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidefold.errors import ProtocolError, SchemaDriftError
from tidefold.operators.changes import CHANGE_DDL
from tidefold.sources.wire import UNCHANGED, Begin, Commit, Delete, Insert, Origin, Relation, Truncate, Type, Update, Values, decode


class Assembler:
    """Change rows of whole transactions from messages in order.

    Rows wait until their transaction ends; a transaction without rows, or with rows of other tables only, gives
    one row of op C, so that the position goes on.  ``needed``: by table, the columns that views need; a table that is not in it is
    left out.  A relation that was renamed, or lacks or retypes a needed column, halts the stream.
    """

    def __init__(self, needed: dict[str, tuple[str, ...]] | None = None) -> None:
        self.needed, self.relations, self.rows = needed, {}, None

    def feed(self, frame: bytes) -> list[tuple]:
        m = decode(frame)
        if isinstance(m, Relation):
            self._announce(m)
        elif isinstance(m, Begin):
            if self.rows is not None:
                raise ProtocolError("a transaction begins within another")
            self.rows = []
        elif isinstance(m, Commit):
            if m.end_lsn >= 1 << 63:
                raise ProtocolError(f"log position {m.end_lsn} does not fit a long")
            rows, self.rows = self.rows or [("C", None, None, None, None)], None
            return [(m.end_lsn, seq, *row) for seq, row in enumerate(rows)]
        elif not isinstance(m, (Origin, Type)):
            if self.rows is None:
                raise ProtocolError(f"{type(m).__name__} outside a transaction")
            self.rows += self._changes(m)
        return []

    def _announce(self, m: Relation) -> None:
        known, table = self.relations.get(m.rel_id), f"{m.schema}.{m.name}"
        if known and (known.schema, known.name) != (m.schema, m.name):
            old = f"{known.schema}.{known.name}"
            if self.needed is None or old in self.needed or table in self.needed:
                raise SchemaDriftError(f"{old} is now {table}")
        there = {c.name: c.oid for c in m.columns}
        for c in (self.needed or {}).get(table, ()):
            if c not in there:
                raise SchemaDriftError(f"{table} no longer has the column {c}")
            if known and any(k.name == c and k.oid != there[c] for k in known.columns):
                raise SchemaDriftError(f"{table}: the type of the column {c} changed")
        self.relations[m.rel_id] = m

    def _wanted(self, rel: Relation) -> bool:
        return self.needed is None or f"{rel.schema}.{rel.name}" in self.needed

    def _changes(self, m: Insert | Update | Delete | Truncate) -> Iterator[tuple]:
        if isinstance(m, Truncate):
            known = [self.relations[r] for r in m.rel_ids if r in self.relations]
            yield from (("T", f"{r.schema}.{r.name}", None, None, None) for r in known if self._wanted(r))
            return
        rel = self.relations.get(m.rel_id)
        if rel is None:
            raise ProtocolError(f"{type(m).__name__} for relation {m.rel_id}, which was not announced")
        if not self._wanted(rel):
            return
        old = None if isinstance(m, Insert) else m.old
        if old is None and not isinstance(m, Insert):
            raise SchemaDriftError(f"{rel.schema}.{rel.name}: an update or delete without its old row; the table needs replica identity full")
        new = None if isinstance(m, Delete) else m.new
        row = lambda values: None if values is None else {k: v for k, v in self._named(rel, values) if v is not UNCHANGED}
        unchanged = [k for k, v in self._named(rel, new) if v is UNCHANGED] if new is not None else None
        yield (type(m).__name__[0], f"{rel.schema}.{rel.name}", row(old), row(new), unchanged)

    @staticmethod
    def _named(rel: Relation, values: Values) -> list[tuple[str, object]]:
        if len(values) != len(rel.columns):
            raise ProtocolError(f"{rel.schema}.{rel.name}: {len(values)} values for {len(rel.columns)} columns")
        return [(c.name, v) for c, v in zip(rel.columns, values, strict=True)]


_CHANGES = pa.schema([("end_lsn", pa.int64()), ("seq", pa.int32()), ("op", pa.string()), ("table", pa.string()), ("old", pa.map_(pa.string(), pa.string())), ("new", pa.map_(pa.string(), pa.string())), ("unchanged", pa.list_(pa.string()))])


def change_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in _CHANGES]
    columns[4:6] = [[None if r is None else list(r.items()) for r in c] for c in columns[4:6]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _CHANGES, strict=True)], schema=_CHANGES)


def decode_log(frames: DataFrame, needed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Change rows of ``frames(segment, n, payload)``: ordered by n in each segment.  A transaction that a segment leaves open is not given out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, assembler = object(), Assembler(needed)
        for batch in batches:
            rows: list[tuple] = []
            for s, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != segment:
                    segment, assembler = s, Assembler(needed)
                rows += assembler.feed(payload)
            yield change_batch(rows)

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = frames.repartition(parts, "segment").sortWithinPartitions("segment", "n").select("segment", "payload")
    return ordered.mapInArrow(run, CHANGE_DDL)
