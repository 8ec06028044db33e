"""Bounded, repeatable samples of labelled and unlabelled texts to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, share, staged


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most_labelled: int, most_unlabelled: int = 0, only: int | None = None) -> DataFrame:
    """Staged (doc_id, text, label): about most_labelled rows with a label, and most_unlabelled of any (label null).

    Labels come from rows of folds 1 to 4 alone, and so do the unlabelled texts. `only` keeps the rows with that label.
    Where `labels` has several labels for one id, the smallest counts. Texts that are equal count once for a label, under the
    smallest id, so a large group of copies doesn't outweigh others. The samples are chosen by a hash of the id; what is
    broadcast is their ids, whose number the parameters bound.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (fold("doc_id") != 0))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.where(F.col("label") == only) if only is not None else known
    rows = known.where(share(F.col("doc_id"), most_labelled, known.count()))
    ids = docs.select("doc_id").where(fold("doc_id") != 0)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    if most_unlabelled:
        some = docs.select("doc_id", "text", F.lit(None).cast("int").alias("label"))
        found = found.unionByName(some.where((fold("doc_id") != 0) & share(F.col("doc_id") + 1, most_unlabelled, ids.count())))
    one = found.groupBy(F.xxhash64("text").alias("same"), "label").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    return staged(one.select("doc_id", "text", "label"), f"train-{label}")
