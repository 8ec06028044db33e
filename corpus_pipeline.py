"""A training corpus from raw documents: quality, toxicity, near duplicates, mixing, packing, each by one operator of spindrel.llm.

A stage takes (spark, docs, sf_dir) and returns what it makes of docs, which is written as Parquet and read again for the
next. All stages but the last return the columns of documents. No stage is expressed in SQL; the tests hold each against a
plain version of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm import jaccard, mixing, packing, quality, toxicity
from spindrel.llm.common import staged, table, tuned
from spindrel.llm.tokens import public_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality isn't rejected; the classifier learns from labels of documents that are in docs.

    A null or empty text is judged as the empty text; repeated rows and rows with equal or null ids are judged one by one;
    an empty table gives an empty one, and without labels of both kinds all score alike; only the columns of documents stay.
    """
    docs = docs.select(*COLUMNS)
    tuned(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.GOOD).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic.

    A null or empty text is judged as the empty text; repeated rows and rows with equal or null ids are judged one by one;
    an empty table gives an empty one, and without a toxic label nothing is dropped; only the columns of documents stay.
    """
    docs = docs.select(*COLUMNS)
    tuned(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < 0.5).select(*COLUMNS)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own for each row. It is written with the rows, so it stays whatever is read twice."""
    return staged(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the row with the smallest id, one without id only if none
    has any; rows without words stay. Rows are told apart by their numbers, not by their ids; of repeated rows one stays; an
    empty table gives an empty one."""
    tuned(spark)
    rows = numbered(docs, "rows")
    groups = jaccard.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), k=5, num=4, den=5)
    placed = rows.select("row", "doc_id").join(groups.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = placed.groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it. Rows of equal or null ids are taken one by one; a null source is a source; rows
    without words have no size and come as their places in the mix have it; an empty table gives an empty one."""
    tuned(spark)
    rows = numbered(docs, "rows")
    copies = mixing.mix(rows, carried="row").where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    found = rows.join(copies, "row")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that fill windows of 2048 tokens. A null text is its end id alone; rows of equal or null ids are packed one by
    one; an empty table gives no piece."""
    tuned(spark)
    return packing.pack(docs, public_vocabulary(), capacity=2048, end_id=1)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
