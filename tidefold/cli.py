"""Commands: setup, run, status, teardown.  ``--help`` and ``--version`` load no Spark."""

from __future__ import annotations

import argparse
import logging
import signal
import sys
from collections.abc import Sequence


def _parser() -> argparse.ArgumentParser:
    from tidefold import __version__

    p = argparse.ArgumentParser(prog="tidefold", description="Aggregate views kept equal to a fresh GROUP BY.")
    p.add_argument("--version", action="version", version=f"tidefold {__version__}")
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in (("setup", "backfill the views and write the first checkpoint"), ("run", "follow the log of changes"), ("status", "positions, lag and rows of the views"), ("teardown", "remove the views and the checkpoint")):
        c = commands.add_parser(name, help=text)
        c.add_argument("-c", "--config", required=True, help="the views' definition file")
        c.add_argument("--root", required=True, help="shared folder of the views")
        if name == "setup":
            c.add_argument("--tables", required=True, help="folder with <schema>.<table>.parquet or <table>.parquet")
            c.add_argument("--lsn", type=int, help="the log's position as of which the tables are; else its end, which must stand still meanwhile")
            c.add_argument("--force", action="store_true", help="start over where views are set up")
        if name in ("setup", "run", "status"):
            c.add_argument("--log", required=name == "run", help="folder of the log of changes")
        if name == "run":
            c.add_argument("--checkpoint", required=True, help="folder of the stream's own checkpoint")
        if name == "teardown":
            c.add_argument("--yes", action="store_true", help="really remove them")
    return p


def logging_to_stderr() -> None:
    """One handler however often it is called."""
    log = logging.getLogger("tidefold")
    if not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)


def _snapshots(spark, config, folder: str) -> dict:
    from pyspark.errors import AnalysisException

    from tidefold.errors import SetupError

    found = {}
    for source in config.sources:
        names = [source] + [source.split(".")[1]] * source.startswith("public.")
        for n in names:
            try:
                found[source] = spark.read.parquet(f"{folder}/{n}.parquet")
                break
            except AnalysisException:
                continue
        else:
            raise SetupError(f"no table {source} in {folder}")
    return found


def table(info: dict[str, object]) -> str:
    """The status: the manifest that holds, the log's positions, and for each view its rows and runs."""
    from tidefold.functions.lsn import format_lsn

    if not info["exists"]:
        return f"{info['slot']}: absent, run setup" + "".join(f"\n  {v}: no state" for v in info["views"])
    at = {k: "unknown" if info[k] is None else format_lsn(info[k]) for k in ("checkpoint_lsn", "acknowledged_lsn", "current_lsn")}
    batch = "setup" if info["batch"] is None else f"batch {info['batch']}"
    head = f"{info['slot']}: manifest {info['manifest']} ({batch}) holds everything up to {at['checkpoint_lsn']}, {'active' if info['active'] else 'inactive'}"
    log = f"log: ends at {at['current_lsn']}, acknowledged up to {at['acknowledged_lsn']}, {'unknown' if info['lag'] is None else info['lag']} behind"
    return "\n".join([head, log, *(f"  {v}: {n} rows in {info['runs'].get(v, 0)} runs" for v, n in info["views"].items())])


def _consistent(read, position, tries: int = 5):
    """What ``read`` lists, and the log's position as of that: the position is taken first and must still hold afterwards.

    A change that is logged in between might be in the tables or not, so that neither position would be right.
    """
    from tidefold.errors import SetupError

    for _ in range(tries):
        before = position()
        found = read()
        if position() == before:
            return found, before
    raise SetupError("the log does not stand still while the tables are listed; stop the writer or give --lsn")


def _do(args: argparse.Namespace) -> int:
    from tidefold.plans.spec import load_config

    config = load_config(args.config)
    if args.command == "teardown" and not args.yes:
        print("teardown removes the views and their checkpoint; add --yes to do so")
        return 2
    from pyspark.sql import SparkSession

    from tidefold.functions.shared import qualified
    from tidefold.sources.changelog import latest_lsn
    from tidefold.streaming.engine import Engine

    spark = SparkSession.builder.appName("tidefold").getOrCreate()
    engine = Engine(spark, config, args.root)
    if args.command == "setup":
        end = lambda: args.lsn if args.lsn is not None else latest_lsn(qualified(spark, args.log)) if args.log else 0
        snapshots, lsn = _consistent(lambda: _snapshots(spark, config, args.tables), end)
        engine.setup(snapshots, lsn, force=args.force)
        print(f"{len(config.views)} views are set up; next: tidefold run -c {args.config} --root {args.root}")
    elif args.command == "run":
        asked: list[int] = []
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda number, frame: asked.append(number))
        query = engine.run(args.log, args.checkpoint)
        while not asked and not query.awaitTermination(1):
            pass
        engine.stop(query)
    elif args.command == "status":
        print(table(engine.status(args.log)))
    else:
        engine.teardown()
        print("removed")
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    """Exit status: 0 done, 1 an error of the engine (one line on stderr), 2 wrong usage."""
    from tidefold.errors import EngineError

    args = _parser().parse_args(argv)
    logging_to_stderr()
    try:
        return _do(args)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
