"""The commit store: all views' states and the log position become visible together, in one rename.

``manifests/<number>.json`` names, for each view, the schema and the runs of its state: folders of rows that add up.
What a commit writes counts once its manifest is there; a reader always sees one manifest.  Manifests but
the last few go with each commit, and the folders that compaction replaced some time later, so that readers may finish.
What a failed attempt wrote is in no manifest and is removed by ``sweep``.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from tidefold.errors import EngineError


@dataclass(frozen=True)
class Run:
    """A folder of state rows and its size."""

    path: str
    bytes: int


@dataclass(frozen=True)
class ViewVersion:
    """A view's state: the sum of its runs, the oldest first."""

    state: dict
    source: dict
    runs: tuple[Run, ...]


@dataclass(frozen=True)
class Manifest:
    """``setup``: an id of the setup that this one goes back to; ``retired``: replaced folders, and when they were replaced."""

    number: int
    slot: str
    checkpoint_lsn: int
    batch_id: int | None
    views: dict[str, ViewVersion]
    setup: str = ""
    retired: tuple[tuple[str, float], ...] = ()
    updated_at: float = field(default_factory=time.time)


class CommitStore:
    KEEP, RETAIN_SECONDS = 3, 600.0

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.files = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        self.none = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def numbers(self) -> list[int]:
        at = self._path("manifests")
        if not self.files.exists(at):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "._")

    def read(self, number: int) -> Manifest:
        stream = self.files.open(self._path(f"manifests/{number:012d}.json"))
        try:
            raw = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        views = {k: ViewVersion(v["state"], v["source"], tuple(Run(**r) for r in v["runs"])) for k, v in raw["views"].items()}
        return Manifest(**raw | {"views": views, "retired": tuple((p, t) for p, t in raw["retired"])})

    def latest(self) -> Manifest | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def publish(self, manifest: Manifest) -> None:
        """Make a manifest visible; if another has its number, nothing changes and an error is raised.

        Afterwards what is due goes: folders that were replaced ``RETAIN_SECONDS`` ago, and the manifest ``KEEP`` before.
        """
        tmp, to = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{manifest.number:012d}.json")
        out = self.files.create(tmp, False)
        try:
            out.write(json.dumps(asdict(manifest)).encode())
        finally:
            out.close()
        try:
            self.context.rename(tmp, to, self.none)
        except Exception as e:
            self.files.delete(tmp, False)
            raise EngineError(f"manifest {manifest.number} exists; another engine runs on {self.root}") from e
        for path, _ in self.due(manifest):
            self.delete(path)
        if manifest.number >= self.KEEP:
            self.remove(f"manifests/{manifest.number - self.KEEP:012d}.json")

    def due(self, manifest: Manifest) -> list[tuple[str, float]]:
        """The replaced folders that no reader can still need; they stay named for one manifest more than they are there."""
        return [x for x in manifest.retired if x[1] < manifest.updated_at - self.RETAIN_SECONDS]

    def new_folder(self, view: str) -> str:
        return f"{self.root}/views/{view}/{uuid.uuid4().hex}"

    def size(self, folder: str) -> int:
        return self.files.getContentSummary(self.jvm.org.apache.hadoop.fs.Path(folder)).getLength()

    def delete(self, folder: str) -> None:
        self.files.delete(self.jvm.org.apache.hadoop.fs.Path(folder), True)

    def remove(self, name: str) -> None:
        self.files.delete(self._path(name), True)

    def remove_all(self) -> None:
        """Manifests first: without them nothing else counts."""
        self.remove("manifests")
        self.files.delete(self.jvm.org.apache.hadoop.fs.Path(self.root), True)

    def sweep(self, keep: int = KEEP) -> None:
        """Remove all manifests but the last ones, and the folders that none of those names; for when nobody reads or writes."""
        numbers = self.numbers()
        held = {r.path for n in numbers[-keep:] for v in self.read(n).views.values() for r in v.runs}
        for n in numbers[:-keep]:
            self.remove(f"manifests/{n:012d}.json")
        views = self._path("views")
        for view in self.files.listStatus(views) if self.files.exists(views) else []:
            for version in self.files.listStatus(view.getPath()):
                if f"{self.root}/views/{view.getPath().getName()}/{version.getPath().getName()}" not in held:
                    self.files.delete(version.getPath(), True)
