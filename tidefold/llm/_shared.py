"""Tables in the cluster's shared folder, and distributed connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.shared import shared_dir

#: Separators of words in every contract: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


class Tables:
    """Intermediate results written as Parquet below the shared folder.

    A written table cuts the lineage: when an executor is lost, later stages read
    the table again and recompute nothing before it.  ``drop`` removes tables that
    no result still reads.  With ``lean`` the shuffle files of a table go as soon as it
    is written; else they stay until the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, lean: bool = False) -> None:
        self.spark, self.root, self.made, self.lean = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, lean

    def new_path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}"

    def keep(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """The table written and read again; ``batch``: rows that Python gets at once while it is written."""
        path, at, free = self.new_path(), "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before, freed = self.spark.conf.get(at), self.spark.conf.get(free, "false")
        try:
            self.spark.conf.set(at, str(batch or before))
            self.spark.conf.set(free, "true" if self.lean else freed)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(at, before)
            self.spark.conf.set(free, freed)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def lower_ascii(c: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(df: DataFrame, condition: Column | str) -> DataFrame:
    """The rows for which a costly condition holds.

    ``where`` would be moved below the projections that the condition reads, and evaluate all of them once more for each
    place where they are used.  A generator stays where it is.
    """
    held = F.expr(condition) if isinstance(condition, str) else condition
    return df.select(F.inline(F.when(held, F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])))))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, which the table must have.  Further columns, whatever their names, are left out."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``: rows ``(id, component)``.

    ``component`` is the smallest id reachable.  Ids that are in no edge, or only in
    an edge with themselves, are left out.  Alternates large-star and small-star
    contraction until the edges stand still; each round is a pre-aggregated minimum by
    vertex and an inner join with it (whose hot side Spark can split), written to
    the shared folder.
    """
    e = tables.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or now == state:
            break
        state = now
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        e, old = tables.keep(small), e
        tables.drop(old)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
