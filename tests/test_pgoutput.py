"""The replication protocol: messages, values, transactions."""

from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest

from tidefold.errors import ProtocolError, SchemaDriftError
from tidefold.functions.lsn import format_lsn, lsn_from_text, lsn_to_text, parse_lsn
from tidefold.functions.values import convert_value
from tidefold.errors import EngineError
from tidefold.sources import pgoutput as p
from tidefold.sources import wire as w


class f:
    """Frames from few values."""

    begin = staticmethod(lambda lsn, xid=1, micros=0: w.encode(w.Begin(lsn, w.EPOCH + timedelta(microseconds=micros), xid)))
    commit = staticmethod(lambda lsn, end: w.encode(w.Commit(0, lsn, end, w.EPOCH)))
    relation = staticmethod(lambda rel, schema, name, columns: w.encode(w.Relation(rel, schema, name, "f", tuple(w.Column(c, o, -1, False) for c, o in columns))))
    insert = staticmethod(lambda rel, new: w.encode(w.Insert(rel, tuple(new))))
    truncate = staticmethod(lambda rels, options=0: w.encode(w.Truncate(options, tuple(rels))))
    origin = staticmethod(lambda lsn, name: w.encode(w.Origin(lsn, name)))
    type_info = staticmethod(lambda oid, schema, name: w.encode(w.Type(oid, schema, name)))

    @staticmethod
    def update(rel, new, old=None, tag="O"):
        return w.encode(w.Update(rel, old and tag == "O" and tuple(old) or None, old and tag == "K" and tuple(old) or None, tuple(new)))

    @staticmethod
    def delete(rel, old, tag="O"):
        return w.encode(w.Delete(rel, tuple(old) if tag == "O" else None, tuple(old) if tag == "K" else None))


def test_frames_are_those_of_the_protocol():
    """Bytes written down by hand."""
    assert f.begin(0x102, 7, 3) == b"B" + bytes([0] * 6 + [1, 2] + [0] * 7 + [3, 0, 0, 0, 7])
    assert f.commit(1, 2) == b"C\0" + bytes([0] * 7 + [1] + [0] * 7 + [2] + [0] * 8)
    assert f.relation(5, "s", "t", [("a", 23)]) == b"R\0\0\0\5s\0t\0f\0\1\0a\0\0\0\0\x17\xff\xff\xff\xff"
    assert f.insert(5, ["ab", None, w.UNCHANGED]) == b"I\0\0\0\5N\0\3t\0\0\0\2abnu"
    assert f.update(5, ["b"], ["a"]) == b"U\0\0\0\5O\0\1t\0\0\0\1aN\0\1t\0\0\0\1b"
    assert f.delete(5, ["a"], "K") == b"D\0\0\0\5K\0\1t\0\0\0\1a"
    assert f.truncate([5, 6], 1) == b"T\0\0\0\2\1\0\0\0\5\0\0\0\6"
    assert f.origin(1, "o") == b"O" + bytes([0] * 7 + [1]) + b"o\0" and f.type_info(9, "s", "t") == b"Y\0\0\0\x09s\0t\0"



COLUMNS = [("status", 25), ("total", 1700), ("note", 25)]
REL = f.relation(5, "public", "orders", COLUMNS)


def test_messages_come_back():
    assert w.decode(f.begin(9, 3, 1_000_000)) == w.Begin(9, datetime(2000, 1, 1, 0, 0, 1, tzinfo=UTC), 3)
    assert w.decode(f.commit(9, 10)) == w.Commit(0, 9, 10, w.EPOCH)
    rel = w.decode(REL)
    assert (rel.rel_id, rel.schema, rel.name, rel.identity) == (5, "public", "orders", "f") and [(c.name, c.oid, c.key) for c in rel.columns] == [(n, o, False) for n, o in COLUMNS]
    assert w.decode(f.insert(5, ["é", None, w.UNCHANGED])) == w.Insert(5, ("é", None, w.UNCHANGED))
    assert w.decode(f.update(5, ["b"])) == w.Update(5, None, None, ("b",))
    assert w.decode(f.update(5, ["b"], ["a"])) == w.Update(5, ("a",), None, ("b",))
    assert w.decode(f.update(5, ["b"], ["a"], "K")) == w.Update(5, None, ("a",), ("b",))
    assert w.decode(f.delete(5, ["a"])) == w.Delete(5, ("a",), None)
    assert w.decode(f.delete(5, ["a"], "K")) == w.Delete(5, None, ("a",))
    assert w.decode(f.truncate([5, 6], 3)) == w.Truncate(3, (5, 6))
    assert w.decode(f.origin(1, "o")) == w.Origin(1, "o") and w.decode(f.type_info(9, "s", "t")) == w.Type(9, "s", "t")


@pytest.mark.parametrize("frame", [b"", b"Zx", f.begin(1)[:-1], REL[:-3], f.insert(5, ["abc"])[:-1], f.insert(5, ["abc"]).replace(b"N", b"X"), f.insert(5, ["a"]).replace(b"t\0", b"b\0"), f.delete(5, ["a"]).replace(b"O", b"N"), f.origin(1, "o")[:-1], REL.replace(b"f\0\x03", b"z\0\x03"), b"I\0\0\0\5N\0\1t\0\0\0\1\xff"])
def test_malformed_messages(frame):
    with pytest.raises(ProtocolError):
        w.decode(frame)


def test_values():
    assert convert_value(None, 25) is None
    assert [convert_value(x, 16) for x in "tf"] == [True, False]
    assert [convert_value("7", o) for o in (20, 21, 23, 26)] == [7] * 4
    assert convert_value("0.5", 701) == 0.5 and convert_value("1.10", 1700) == Decimal("1.10") and convert_value("2024-01-01", 1082) == "2024-01-01"


def test_positions(spark):
    assert parse_lsn("16/B374D848") == 97500059720 and format_lsn(97500059720) == "16/B374D848"
    for bad in ("", "1", "x/y", "1/2/3"):
        with pytest.raises(EngineError):
            parse_lsn(bad)
    df = spark.createDataFrame([("16/B374D848",), ("0/0",), ("7FFFFFFF/FFFFFFFF",)], "t string")
    assert [tuple(r) for r in df.select(lsn_from_text(df.t).alias("n"), lsn_to_text(lsn_from_text(df.t)).alias("t")).collect()] == [(97500059720, "16/B374D848"), (0, "0/0"), (2**63 - 1, "7FFFFFFF/FFFFFFFF")]


def assembled(*frames, needed=None):
    a = p.Assembler(needed)
    return [r for x in frames for r in a.feed(x)]


def test_transactions():
    got = assembled(f.begin(1), REL, f.origin(1, "x"), f.insert(5, ["new", "1.5", None]), f.update(5, ["paid", "2", w.UNCHANGED], ["new", "1.5", "long"]), f.delete(5, ["paid", "2", "long"]), f.truncate([5, 99]), f.commit(1, 10), f.begin(2), f.commit(2, 20), f.begin(3), f.insert(5, ["open", "1", None]))
    assert [(r[0], r[1], r[2]) for r in got] == [(10, 0, "I"), (10, 1, "U"), (10, 2, "D"), (10, 3, "T"), (20, 0, "C")]
    assert got[0][4:] == (None, {"status": "new", "total": "1.5", "note": None}, [])
    assert got[1][5] == {"status": "paid", "total": "2"} and got[1][6] == ["note"] and got[1][4]["note"] == "long"


def test_tables_without_views_are_left_out():
    got = assembled(f.begin(1), f.relation(8, "public", "other", [("x", 25)]), f.insert(8, ["1"]), f.commit(1, 10), needed={"public.orders": ("status",)})
    assert got == [(10, 0, "C", None, None, None, None)]


@pytest.mark.parametrize("bad", [[f.insert(5, ["a", "1", "n"])], [f.begin(1), f.insert(77, ["a"])], [f.begin(1), f.begin(2)], [REL, f.begin(1), f.insert(5, ["a"])], [f.begin(1), f.commit(1, 1 << 63)]])
def test_broken_streams(bad):
    with pytest.raises(ProtocolError):
        assembled(*bad)


@pytest.mark.parametrize(
    "bad",
    [
        [REL, f.relation(5, "public", "renamed", COLUMNS)],
        [REL, f.relation(5, "moved", "orders", COLUMNS)],
        [f.relation(5, "public", "orders", COLUMNS[1:])],
        [REL, f.relation(5, "public", "orders", [("status", 23), *COLUMNS[1:]])],
        [REL, f.begin(1), f.update(5, ["a", "1", "n"])],
        [REL, f.begin(1), f.update(5, ["a", "1", "n"], ["b", "1", "n"], "K")],
        [REL, f.begin(1), f.delete(5, ["a", "1", "n"], "K")],
    ],
)
def test_drift_halts(bad):
    with pytest.raises(SchemaDriftError):
        assembled(*bad, needed={"public.orders": ("status", "total")})


def test_more_columns_are_no_drift():
    assembled(REL, f.relation(5, "public", "orders", [*COLUMNS, ("more", 25)]), needed={"public.orders": ("status",)})


def test_segments_are_decoded_apart(spark):
    rows = []
    for s in range(5):
        stream = [f.begin(s + 1), REL, f.insert(5, [f"s{s}", "1", None]), f.commit(s + 1, s + 1), f.begin(99), f.insert(5, ["open", "1", None])]
        rows += [(s, n, bytearray(x)) for n, x in enumerate(stream)]
    got = p.decode_log(spark.createDataFrame(rows, "segment long, n long, payload binary")).collect()
    assert sorted((r["end_lsn"], r["new"]["status"]) for r in got) == [(s + 1, f"s{s}") for s in range(5)]


def test_live_stream_wakes_and_tells(monkeypatch):
    """Against a cursor that plays a server: wakes come while frames trickle in, and what is told is sent at once."""
    import types

    from tidefold.sources import replication

    told, sent = [], iter(range(1, 200))
    cursor = types.SimpleNamespace(read_message=lambda: types.SimpleNamespace(wal_end=next(sent), payload=b"x"), send_feedback=lambda **k: told.append(k))
    stream = replication.LiveStream.__new__(replication.LiveStream)
    stream.cursor, stream.flushed, stream.told, stream.stopped = cursor, 0, 0.0, False
    clock = iter(x / 10 for x in range(10_000))
    monkeypatch.setattr(replication.time, "monotonic", lambda: next(clock))
    got = []
    for x in stream.frames(1.0):
        got.append(x)
        if len(got) == 40:
            stream.stop()
    assert got.count(None) >= 3 and [x[0] for x in got if x] == list(range(1, 41 - got.count(None)))
    stream.acknowledge(7)
    assert told[-1] == {"write_lsn": 7, "flush_lsn": 7, "apply_lsn": 7, "force": True}
