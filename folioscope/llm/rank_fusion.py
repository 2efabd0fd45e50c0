"""One ranking from several differently scaled scores, by robust rank aggregation.

Within a group each score becomes a rank, and the rank divided by the group's size is uniform under the
hypothesis that the score says nothing. An item's normalised ranks are sorted; the k-th smallest of K uniform
values is at most r with the probability of the beta order statistic, P(Bin(K, r) >= k). The least of these
probabilities, corrected for being the least of K, is the item's significance; the smallest goes first.

Ties share the worse rank, a missing score ranks behind all present ones. Equal significances are ordered by
the sum of the ranks, then by key. NaN counts as missing. Rows with a null group or key are left out; a row
delivered again (the same group and item) counts once. An empty table gives an empty result.

A group of more than `hot_rows` rows never meets in one task: its ranks come from counts by ranges of the score, its
positions from ranges of the whole order, each with the number of rows before it.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, staged

#: A group of more rows is not ranked in one task.
HOT, RANGES = 100_000, 256


def _split(df: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the plain groups and those of the hot ones."""
    hot = broadcast_if_small(hot)
    return df.join(hot, "g", "left_anti"), df.join(hot, "g", "left_semi")


def _worst_rank(df: DataFrame, score: str, out: str, hot: DataFrame | None) -> DataFrame:
    """Adds how many rows of the group g are at least as good; nulls count as equal and worst."""
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last(score)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if hot is None:
        return df.withColumn(out, F.count(F.lit(1)).over(w))
    plain, big = _split(df, hot)
    plain = plain.withColumn(out, F.count(F.lit(1)).over(w))
    cuts = big.groupBy("g").agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    cuts = broadcast_if_small(staged(cuts, "cuts"), 10_000)
    per = big.where(F.col(score).isNotNull()).groupBy("g", score).agg(F.count("*").alias("n")).join(cuts, "g")
    per = staged(per.withColumn("range", F.size(F.filter("cuts", lambda c: c >= F.col(score)))).drop("cuts"), "values")
    before = per.groupBy("g", "range").agg(F.sum("n").alias("n"))
    before = before.select("g", "range", (F.sum("n").over(Window.partitionBy("g").orderBy("range")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("g", "range").orderBy(F.desc(score))
    place = per.withColumn("n", F.sum("n").over(inner)).join(broadcast_if_small(staged(before, "ranges")), ["g", "range"])
    place = place.select("g", score, (F.col("n") + F.col("before")).alias(out))
    known = big.where(F.col(score).isNotNull()).join(place, ["g", score])
    missing = big.where(F.col(score).isNull()).withColumn(out, F.col("size"))
    return plain.unionByName(known).unionByName(missing)


def order_statistic(r: Column, k: int, n: int) -> Column:
    """P(the k-th smallest of n uniform values <= r)."""
    return reduce(lambda a, b: a + b, (F.lit(float(comb(n, i))) * F.pow(r, F.lit(i)) * F.pow(1 - r, F.lit(n - i)) for i in range(k, n + 1)))


def aggregate_ranks(df: DataFrame, group: str, item: str, scores: list[str], hot_rows: int = HOT) -> DataFrame:
    """group, item, the scores, significance, position: position 1 is the first of its group."""
    n = len(scores)
    own = [f"s{i}" for i in range(n)]  # names of its own, whatever the columns are called
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), *(F.col(c).cast("double").alias(s) for c, s in zip(scores, own)))
    rows = rows.select("g", "item", *(F.when(~F.isnan(s), F.col(s)).alias(s) for s in own)).where("g is not null and item is not null")
    rows = staged(rows.groupBy("g", "item").agg(*(F.max(s).alias(s) for s in own)), "scores")
    sizes = staged(rows.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    hot = sizes.where(F.col("size") > hot_rows).select("g")  # at most one in hot_rows rows
    hot = hot if hot.limit(1).count() else None
    ranked = rows.join(broadcast_if_small(sizes), "g")
    for i, s in enumerate(own):
        ranked = _worst_rank(ranked, s, f"rank{i}", hot)
    ranked = ranked.withColumn("r", F.array_sort(F.array(*(F.col(f"rank{i}") / F.col("size") for i in range(n)))))
    least = F.array_min(F.array(*(order_statistic(F.col("r")[k - 1], k, n) for k in range(1, n + 1))))
    total = reduce(lambda a, b: a + b, (F.col(f"rank{i}") for i in range(n)))
    ranked = ranked.select("g", "item", *own, F.least(F.lit(1.0), F.lit(float(n)) * least).alias("significance"), total.alias("total"))
    ranked = _positions(ranked, hot)
    return ranked.select(F.col("g").alias(group), F.col("item").alias(item), *(F.col(s).alias(c) for c, s in zip(scores, own)), "significance", "position")


def _positions(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    w = Window.partitionBy("g").orderBy("significance", "total", "item")
    if hot is None:
        return df.withColumn("position", F.row_number().over(w).cast("long"))
    plain, big = _split(staged(df, "significances"), hot)
    plain = plain.withColumn("position", F.row_number().over(w).cast("long"))
    # Ranges of the whole order, the item's key included, so that no tie is too large for a task.
    order = ["g", "significance", "total", "item"]
    big = big.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    big = big.withColumns({"_part": F.shiftrightunsigned("_m", 33), "_at": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m")
    big = staged(big, "ordered")
    per = big.groupBy("_part", "g").agg(F.count("*").alias("n"), F.min("_at").alias("_lo"))
    per = per.select("_part", "g", "_lo", (F.sum("n").over(Window.partitionBy("g").orderBy("_part")) - F.col("n")).alias("_before"))
    big = big.join(broadcast_if_small(staged(per, "ranges")), ["_part", "g"])
    return plain.unionByName(big.withColumn("position", F.col("_before") + F.col("_at") - F.col("_lo") + 1).drop("_part", "_at", "_lo", "_before"))
