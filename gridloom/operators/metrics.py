"""Similarity of images and maps: histograms, mutual information, entropy, proficiency, r squared, trends.

Pairs are (by, f, m) rows. Marginals are sums of the joint histogram, whose size is bounded by the bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 50


def joint_histogram(pair: DataFrame, by: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """(by, bx, by_, c): bins round v / max * (bins - 1); the largest value is over both images, values below 0 are in bin 0."""
    top = pair.groupBy(*by).agg(F.greatest(F.max("f"), F.max("m")).alias("_top"))
    joined = pair.join(top, [*by]) if by else pair.crossJoin(F.broadcast(top))  # one row without by
    bin_of = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(F.col(c) / F.when(F.col("_top") != 0, F.col("_top")), F.lit(0.0)) * F.lit(float(bins - 1)) + F.lit(0.5)))).cast("int")
    return joined.groupBy(*by, bin_of("f").alias("bx"), bin_of("m").alias("by_")).agg(F.count("*").alias("c"))


def equal_histogram(pair: DataFrame, by: tuple[str, ...] = (), bins: int = BINS - 1) -> DataFrame:
    """(by, bx, by_, c): equal bins on [0, 1], the last closed; values outside are left out."""
    bin_of = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) * F.lit(float(bins)))).cast("int")
    return pair.filter(F.col("f").between(0, 1) & F.col("m").between(0, 1)).groupBy(*by, bin_of("f").alias("bx"), bin_of("m").alias("by_")).agg(F.count("*").alias("c"))


def mutual_information(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mi) in nats."""
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    shares = histogram.select(*by, F.col("c").cast("double").alias("c"), F.sum("c").over(total.partitionBy(*by, "bx")).alias("cx"), F.sum("c").over(total.partitionBy(*by, "by_")).alias("cy"), F.sum("c").over(total).alias("n"))
    return shares.groupBy(*by).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx").cast("double") * F.col("cy")))).alias("mi"))


def entropy(histogram: DataFrame, column: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, h) in bits, of a marginal (bx or by_) or of the joint histogram (None)."""
    counts = histogram if column is None else histogram.groupBy(*by, column).agg(F.sum("c").alias("c"))
    log2 = lambda c: F.log(c) / F.log(F.lit(2.0))
    return counts.filter("c > 0").groupBy(*by).agg((log2(F.sum("c").cast("double")) - F.sum(F.col("c") * log2(F.col("c").cast("double"))) / F.sum("c")).alias("h"))


def compare_images(pair: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, h1, h2, mi_bits, proficiency): mutual information in bits over the smaller entropy; 0 if that is 0."""
    histogram = equal_histogram(pair, by)
    sides = [entropy(histogram, c, by).withColumnRenamed("h", n) for c, n in (("bx", "h1"), ("by_", "h2"), (None, "h12"))]
    joined = reduce(lambda a, b: a.join(b, [*by]) if by else a.crossJoin(F.broadcast(b)), sides)  # one row each without by
    mi = F.col("h1") + F.col("h2") - F.col("h12")
    least = F.least("h1", "h2")
    return joined.select(*by, "h1", "h2", mi.alias("mi_bits"), F.when(least > 0, mi / least).otherwise(0.0).alias("proficiency"))


def registration_pairs(images: DataFrame) -> DataFrame:
    """(pair_id, f, m): the four pairs of (x, y, z, fixed, moved, accepted, result) that are compared."""
    sides = {"fixed/moved": ("fixed", "moved"), "accepted/fixed": ("accepted", "fixed"), "result/fixed": ("result", "fixed"), "accepted/result": ("accepted", "result")}
    return images.select(F.inline(F.array(*(F.struct(F.lit(k).alias("pair_id"), F.col(a).alias("f"), F.col(b).alias("m")) for k, (a, b) in sides.items()))))


def compare_registration(images: DataFrame) -> DataFrame:
    """One comparison for each pair of (x, y, z, fixed, moved, accepted, result)."""
    return compare_images(registration_pairs(images), ("pair_id",))


def map_r2(both: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, dof, r2) of values a and b of two maps."""
    return both.groupBy(*by, "dof").agg(F.regr_r2("b", "a").alias("r2"))


def delta_stats(delta: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, avg_delta, max_delta) of |value| over displacements; the mean divides by all rows."""
    moved = F.when(F.col("dof") > 0, F.abs("value"))
    return delta.groupBy(*by).agg((F.coalesce(F.sum(moved), F.lit(0.0)) / F.count("*")).alias("avg_delta"), F.coalesce(F.max(moved), F.lit(0.0)).alias("max_delta"))


def trend(order: str, value: str, by: tuple[str, ...] = (), last: int = 5) -> Column:
    """Slope of a line through the last values."""
    return F.regr_slope(F.col(value), F.col(order)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - last, 0))
