"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with `target`: all sizes together, shared out by weight, none above `most` times its own.

    Sources in code point order, null last, get the weights in turn. Resharing the excess until no source is above its limit
    comes to one level: a source gets the lesser of its limit and weight times level. With sources ordered by limit/weight,
    the level is (total - limits of those before) / (weights from here on) at the first source whose limit isn't below it;
    from there on that quotient falls, so it's the largest of those that keep to their limit.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("_weight", pick.cast("long")).withColumn("_limit", F.col("source_size") * most)
    df = df.withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    df = df.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_weight").over(everything))
    df = df.withColumn("_before", F.coalesce(F.sum("_limit").over(by_level), F.lit(0)))
    df = df.withColumn("_after", F.col("_weights") - F.coalesce(F.sum("_weight").over(by_level), F.lit(0)))
    df = df.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_after"))
    df = df.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    target = F.when(F.col("_level").isNull() | (F.col("_ratio") <= F.col("_level")), F.col("_limit").cast("double")).otherwise(F.col("_weight") * F.col("_level"))
    return df.withColumn("target", target).select("source", "source_size", "target")


#: Tiers of a source's documents by size: the first has half of its words, the next half of the rest, and so on; the last all that is left.
TIERS = 7


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, a multiple of 2**-16 below 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))), 1, 4), 16, 10).cast("double") / 65536


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's number within its source and partition, from 1, and the words before it there; rows of a source come together."""
    last, n, words, any_row = None, 0, 0, False
    for b in batches:
        ranks, sums = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
        for i, (s, size) in enumerate(zip(b.column("source").to_pylist(), b.column("size").to_pylist(), strict=True)):
            n, words = (n + 1, words) if any_row and s == last else (1, 0)
            last, any_row, ranks[i], sums[i] = s, True, n, words
            words += size
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranks), pa.array(sums)], [*b.schema.names, "rank", "sum"])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, carried: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (= copies * size), and the long column `carried`.

    One systematic pass for each source: documents in order of size, the largest first (ties by a hash of the id), their
    expected copies summed up, one random offset added, and a copy for each whole number that the sum passes. All documents of
    a tier expect the same: what is left of the target after the copies of the tiers before, over what is left of the words,
    `most` at most. So a tier makes up for what the one before took too much or too little, and the words taken come within
    about one document of the last tier, which has the smallest, of the target. The running sums are taken over range
    partitions of (source, size, hash), first within each, then across them by their counts; a source with most rows spreads
    over many tasks.

    Null text counts as empty (size 0); a null source is a source of its own; doc_id may be of any type; rows that are equal
    in every way count one by one; an empty table gives an empty result; other columns are ignored.
    """
    more = [carried] if carried else []
    sized = docs.select("doc_id", *more, "source", word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    parts = sized.repartitionByRange(F.col("source"), F.desc("size"), "key").sortWithinPartitions("source", F.desc("size"), "key")
    parts = parts.withColumn("part", F.spark_partition_id()).select("doc_id", *more, "source", "size", "part")
    kind = T.StructType([*parts.schema.fields, T.StructField("rank", T.LongType()), T.StructField("sum", T.LongType())])
    ranked = staged(parts.mapInArrow(_counted, kind), "mix")

    counts = ranked.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("words_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    targets = staged(source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets", together=True)
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    places = counts.alias("a").join(targets.alias("b"), same).select("a.source", "part", "before", "words_before", "source_size", "target")
    places = staged(places, "mix-places", together=True)  # a row for each source and partition; each tier's plan would make them anew
    placed = ranked.alias("a").join(places.alias("b"), (F.col("a.part") == F.col("b.part")) & same)
    tier = sum(((F.col("words_before") + F.col("sum")) * 2**j >= F.col("source_size") * (2**j - 1)).cast("int") for j in range(1, TIERS))
    placed = placed.select("doc_id", *more, "a.source", "size", "source_size", "target", (F.col("before") + F.col("rank")).alias("i"), tier.alias("tier"))

    def passed(i: Column) -> Column:
        """Whole numbers that the expected copies of the first i documents pass, i being in or at the start of a tier."""
        return F.floor(F.col("base") + (i - F.col("n")) * F.col("rate") + F.col("u"))

    copies = F.least(passed(F.col("i")) - passed(F.col("i") - 1), F.lit(most)).cast("long")

    def expecting(state: DataFrame) -> DataFrame:
        left = F.col("source_size") - F.col("words")
        rate = F.when(left > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), (F.col("target") - F.col("given")) / left)))
        return state.withColumn("rate", F.coalesce(rate, F.lit(0.0)))

    zero = F.lit(0).cast("long")
    state = expecting(targets.select("source", "source_size", "target", offset(F.col("source"), seed).alias("u"), zero.alias("n"), zero.alias("words"), zero.alias("given"), F.lit(0.0).alias("base")))
    states = []
    for k in range(TIERS):
        state = staged(state, "mix-state") if k else state  # a row for each source
        states.append(state.select("source", "n", "base", "rate", "u", F.lit(k).alias("tier")))
        if k + 1 < TIERS:
            own = placed.where(F.col("tier") == k).select("source", "size", "i").alias("a").join(states[-1].alias("b"), same)
            sums = own.groupBy("a.source").agg(F.count("*").alias("dn"), F.sum("size").alias("dwords"), F.sum(copies * F.col("size")).alias("dgiven"))
            plus = lambda c: (F.col(c) + F.coalesce(F.col(f"d{c}"), zero)).alias(c)
            both = state.alias("a").join(sums.alias("b"), same, "left")
            state = expecting(both.select("a.source", "source_size", "target", "u", plus("n"), plus("words"), plus("given"), (F.col("base") + F.coalesce("dn", zero) * F.col("rate")).alias("base")))
    ready = reduce(DataFrame.unionByName, states).alias("b")
    out = placed.alias("a").join(ready, same & (F.col("a.tier") == F.col("b.tier"))).withColumn("copies", copies)
    return out.select("doc_id", "a.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)
