"""Feature-distribution profiles: value counts, histograms, summaries.

All of them are single aggregations with map-side partial aggregation; a value
held by a third of all rows costs one partial row per map task.  Histogram
bounds (min/max) are a one-row aggregate joined back as a broadcast (one row:
a proven size bound).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.functions import tokens as K

# Fixed values of the two histograms: equal-width bins between min and max
# (80 per feature, 50 for levenshtein); fixed-edge bins of width 0.05 starting
# at 0.01 (40 per feature, 20 for levenshtein).
EQUAL_WIDTH_BINS = {"dependency": 80, "frequency": 80, "length": 80, "levenshtein": 50}
FIXED_START, FIXED_WIDTH = 0.01, 0.05
FIXED_BINS = {"dependency": 40, "frequency": 40, "length": 40, "levenshtein": 20}


def control_values(lines: DataFrame, col: str = "source_line", keep: Iterable[str] = ("split",)) -> DataFrame:
    """Leading control tokens as rows ``(*keep, pos, name, value)`` (stops at the
    first non-token)."""
    return lines.select(*keep, F.posexplode(K.token_entries(col)).alias("pos", "tok")) \
                .select(*keep, "pos", F.col("tok.name").alias("name"), F.col("tok.value").alias("value"))


def value_counts(values: DataFrame, by_split: str = "split") -> DataFrame:
    """Counts per (name, value) for every split and for the pooled corpus
    (``pooled`` = 1) in one pass: GROUPING SETS ((name, value, split), (name, value))."""
    g = values.groupingSets([["name", "value", by_split], ["name", "value"]], "name", "value", by_split)
    return g.agg(F.grouping(by_split).cast("int").alias("pooled"), F.count(F.lit(1)).alias("cnt"))


def long_features(df: DataFrame, features: Iterable[str], prefix: str = "exact_", keep: Iterable[str] = ()) -> DataFrame:
    """Wide ``{prefix}{feature}`` columns -> rows ``(*keep, feature, x)`` (unpivot)."""
    ks, cols = list(keep), [f"{prefix}{f}" for f in features]
    out = df.select(*ks, *cols).unpivot(ks, cols, "feature", "x")
    return out.withColumn("feature", F.regexp_replace("feature", f"^{prefix}", ""))


def hist_equal_width(values: DataFrame, bins: dict[str, int] | None = None) -> DataFrame:
    """Equal-width histogram per feature between its min and max (80 bins, 50 for
    levenshtein by default), binned as numpy does for uniform bins: index
    ``floor((x - lo) * n / (hi - lo))``, then a one-step correction against the
    edges ``lo + i * (hi - lo) / n`` (last edge = hi, last bin right-closed); a
    zero-width range is widened to ``lo - 0.5 .. hi + 0.5``.  Empty bins are
    omitted.  ``values``: ``(feature, x)``."""
    bins = bins or EQUAL_WIDTH_BINS
    nb = F.lit(None).cast("int")
    for f, n in bins.items():
        nb = F.when(F.col("feature") == f, F.lit(n)).otherwise(nb)
    v = values.where(F.col("x").isNotNull() & ~F.isnan("x"))
    bounds = v.groupBy("feature").agg(F.min("x").alias("lo0"), F.max("x").alias("hi0"))
    same = F.col("lo0") == F.col("hi0")
    bounds = bounds.select("feature",
                           F.when(same, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                           F.when(same, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    # one row per feature: a proven size bound
    j = v.join(F.broadcast(bounds), "feature").withColumn("n_bins", nb)
    n, lo, hi, x = F.col("n_bins"), F.col("lo"), F.col("hi"), F.col("x")
    step = (hi - lo) / n.cast("double")

    def edge(i):
        return F.when(i >= n, hi).otherwise(i.cast("double") * step + lo)

    k0 = F.floor((x - lo) * (n.cast("double") / (hi - lo))).cast("int")
    k1 = F.when(k0 == n, n - 1).otherwise(k0)
    k2 = F.when(x < edge(k1), k1 - 1).otherwise(k1)
    k3 = F.when((x >= edge(k2 + 1)) & (k2 != n - 1), k2 + 1).otherwise(k2)
    out = j.withColumn("bin", k3).groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("cnt"), F.first("lo").alias("lo"), F.first("n_bins").alias("n_bins"),
        F.first("hi").alias("hi"))
    return out.withColumn("bin_lo", edge(F.col("bin"))).drop("lo", "hi")


def hist_fixed(values: DataFrame, split: str | None = "split") -> DataFrame:
    """Histogram of binned values on fixed edges 0.01 + 0.05 i (40 bins; 20 for
    levenshtein), values outside dropped; per split and overall.
    ``values``: ``(feature, value[, split])``."""
    nb = F.lit(None).cast("int")
    for f, n in FIXED_BINS.items():
        nb = F.when(F.col("feature") == f, F.lit(n)).otherwise(nb)
    k = F.floor((F.col("value") - F.lit(FIXED_START)) / F.lit(FIXED_WIDTH)).cast("int")
    v = values.withColumn("bin", k).where((F.col("bin") >= 0) & (F.col("bin") < nb))
    if split:
        g = v.groupingSets([["feature", "bin", split], ["feature", "bin"]], "feature", "bin", split)
    else:
        g = v.groupBy("feature", "bin")
    return g.agg(F.count(F.lit(1)).alias("cnt"))


def feature_summary(values: DataFrame) -> DataFrame:
    """min / max / mean / population std per feature. ``values``: ``(feature, x)``."""
    return values.groupBy("feature").agg(
        F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def rank_profile(log_ranks: DataFrame, keys: Iterable[str] = ("pair_id", "side")) -> DataFrame:
    """Distribution of the admitted tokens' log ranks per sentence: mean, max,
    population sd, median, first and third quartile and their spread."""
    ks = list(keys)
    g = log_ranks.groupBy(*ks).agg(
        F.avg("lr").alias("mean"), F.max("lr").alias("max"), F.stddev_pop("lr").alias("sd"),
        F.percentile("lr", 0.5).alias("median"), F.percentile("lr", 0.25).alias("q1"),
        F.percentile("lr", 0.75).alias("q3"))
    return g.withColumn("iqr", F.col("q3") - F.col("q1"))
