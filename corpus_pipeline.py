"""The corpus pipeline: stages over the table ``documents``, each written as Parquet and reread as the next one's input.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of ``docs``; rows with null ids are cleaned and kept
like others by the first three stages, and stay where a decision is about an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from tidefold.llm._shared import WORD, Tables, only


def _texts(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The rows of docs with the texts of ``cleaned``, which holds the row in ``row`` and the new text."""
    put = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    kept = [put[c].alias(c) if c in put else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cleaned.select(*kept)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every text, and the documents that are not kept go whole."""
    judged = quality_rules.judge(docs, text=True, carry=docs.columns)
    return _texts(docs, only(judged, "kept").withColumnRenamed("text", "cleaned"))


#: Documents that share more of their characters than this with many sites are near copies, which the next stage keeps once.
COPY_PERCENT = 80


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but not from near copies; every document stays."""
    return _texts(docs, line_dedup.clean(docs, most_percent=COPY_PERCENT, carry=docs.columns).withColumnRenamed("text", "cleaned"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one whose id names the group.

    A row without an id is known by a hash of its text, and names a group only if no row of it has an id.  Of rows that repeat
    the kept id one stays.  Texts without words are in no group and stay.
    """
    tables = Tables(spark, "near-duplicates")
    number = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    known = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), number).alias("id"))
    in_group = F.col("row.text").rlike(WORD)
    grouped = known.where(in_group)
    classes = ngram_join.similarity_classes(grouped.select(F.col("id").alias("doc_id"), "row.text"))
    groups = tables.keep(classes.groupBy("doc_id").agg(F.min("component_id").alias("name"), F.count("*").alias("k")).where("k > 1 or doc_id <> name"))
    kept = known.join(groups, (F.col("id") == F.col("doc_id")) & in_group, "left_anti").select("row.*")
    again = groups.where("doc_id = name").select(F.col("doc_id").alias("repeated"))
    if again.isEmpty():
        return kept
    # written first, so that the join with an id of very many rows can be split
    rows = tables.keep(grouped.join(again, F.col("id") == F.col("repeated")).select("id", "row"))
    return kept.unionByName(rows.groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", leaks),
    ("mixing sources to target weights", mix),
]

#: DuckDB's SQL for the rows of ``run``, where the ids of the documents differ.
ORACLE_SQL = f"""
WITH
p1 AS MATERIALIZED (SELECT d.* REPLACE (q.text AS text, length(q.text) AS n_chars) FROM documents d JOIN ({quality_rules.sql(text=True)}) q ON q.doc_id = d.doc_id WHERE q.kept),
p2 AS MATERIALIZED (SELECT d.* REPLACE (q.text AS text, length(q.text) AS n_chars) FROM p1 d JOIN ({line_dedup.sql("p1", COPY_PERCENT)}) q ON q.doc_id = d.doc_id),
p3 AS MATERIALIZED (SELECT d.* FROM p2 d JOIN ({ngram_join.sql("p2")}) q ON q.doc_id = d.doc_id WHERE q.doc_id = q.component_id),
p4 AS MATERIALIZED (SELECT * FROM p3 WHERE doc_id NOT IN (SELECT doc_id FROM ({decontaminate.sql("p3")})))
SELECT * FROM ({mixing.sql("p4")})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.keep(docs)
    return docs
