"""A live replication stream, where psycopg2 is installed: frames in order, acknowledged once they are committed.

Frames are meant to be written to segments that ``pgoutput.decode_log`` or an ``Assembler`` reads.  Nothing here
runs without a server.
"""

from __future__ import annotations

import select
import time
from collections.abc import Iterator

from tidefold.errors import SetupError

KEEPALIVE_SECONDS = 10.0


def _driver():
    try:
        import psycopg2
        import psycopg2.extras
    except ImportError as e:
        raise SetupError("a live stream needs psycopg2") from e
    return psycopg2


class LiveStream:
    """Reads a slot's stream of one publication from where the server's checkpoint is."""

    def __init__(self, dsn: str, slot: str, publication: str) -> None:
        pg = _driver()
        self.connection = pg.connect(dsn, connection_factory=pg.extras.LogicalReplicationConnection)
        self.cursor = self.connection.cursor()
        self.cursor.start_replication(slot_name=slot, decode=False, options={"proto_version": "1", "publication_names": publication})
        self.flushed, self.told, self.stopped = 0, time.monotonic(), False

    def frames(self, wake_seconds: float = 1.0) -> Iterator[tuple[int, bytes] | None]:
        """(position, frame) as they come, until ``stop``; None every ``wake_seconds``, whether frames come or not, so that the caller may flush in time."""
        due = time.monotonic() + wake_seconds
        while not self.stopped:
            self._keep_alive()
            message = self.cursor.read_message()
            if message is not None:
                yield message.wal_end, bytes(message.payload)
            left = due - time.monotonic()
            if left <= 0:
                due = time.monotonic() + wake_seconds
                yield None
            elif message is None:
                select.select([self.cursor], [], [], left)

    def stop(self) -> None:
        """End ``frames`` at its next wake."""
        self.stopped = True

    def acknowledge(self, lsn: int) -> None:
        """Tell the server that everything up to a position is committed here."""
        self.flushed = max(self.flushed, lsn)
        self._tell()

    def _tell(self) -> None:
        # without force the driver may hold the message back until its own interval is over
        self.cursor.send_feedback(write_lsn=self.flushed, flush_lsn=self.flushed, apply_lsn=self.flushed, force=True)
        self.told = time.monotonic()

    def _keep_alive(self) -> None:
        if time.monotonic() - self.told >= KEEPALIVE_SECONDS:
            self._tell()

    def close(self) -> None:
        for x in (self.cursor, self.connection):
            x.close()
