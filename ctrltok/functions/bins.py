"""Fixed-edge binning of feature ratios.

Edges are float64 values ``0.05 + i * 0.05``; a value snaps to the smallest
edge that is >= the value (right-closed bins), values above the last edge clamp
to the last edge, values <= the first edge go to the first edge.  Edges are
binary floats, not decimals: several lie a hair above their nominal value and
one (i = 43, nominal 2.2) lies below it, so 2.2 snaps to 2.25.  The index is
computed arithmetically and then corrected by one step against the exact edge,
which keeps the expression branch-light and inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Feature names, their control-token names, and bin counts.
# dependency, frequency and length use 49 edges (0.05 .. 2.45);
# levenshtein uses 29 edges (0.05 .. 1.45).
# ---------------------------------------------------------------------------
FEATURES = ("dependency", "frequency", "length", "levenshtein")
TOKEN_NAMES = {"dependency": "MaxDep", "frequency": "FreqRank", "length": "Length", "levenshtein": "Leven"}
EDGE_START = 0.05
EDGE_STEP = 0.05
EDGE_COUNT = {"dependency": 49, "frequency": 49, "length": 49, "levenshtein": 29}


def edge_values(feature: str) -> list[float]:
    return [EDGE_START + i * EDGE_STEP for i in range(EDGE_COUNT[feature])]


def _edge(k: Column) -> Column:
    return F.lit(EDGE_START) + k.cast("double") * F.lit(EDGE_STEP)


def bin_index(x, feature: str) -> Column:
    """0-based index of the edge ``x`` snaps to (NULL for NULL/NaN input)."""
    x = F.col(x) if isinstance(x, str) else x
    n = EDGE_COUNT[feature]
    raw = F.ceil((x - F.lit(EDGE_START)) / F.lit(EDGE_STEP))
    k = F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1)).cast("int")
    up = (x > _edge(k)) & (k < F.lit(n - 1))
    down = (k > F.lit(0)) & (x <= _edge(k - F.lit(1)))
    fixed = F.when(up, k + 1).when(down, k - 1).otherwise(k)
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("int")).otherwise(fixed)


def edge_of(k: Column) -> Column:
    """The float64 edge with index ``k``."""
    return _edge(k)


def bin_value(x, feature: str) -> Column:
    """The edge value (float64) that ``x`` snaps to."""
    return _edge(bin_index(x, feature))


def bin_label(x, feature: str) -> Column:
    """Edge value rounded to two decimals, the value printed in control tokens."""
    return F.round(bin_value(x, feature), 2)
