"""Maximum tree depth from a heads array (one row = one text; heads[i] is the
index of token i's parent, a negative value marks a root; several roots = several
sentences, and the text's depth is the maximum over them).

The whole Arrow batch is flattened into one index space and resolved by
pointer jumping (``dist += dist[parent]; parent = parent[parent]``), so a batch
costs O(total tokens * log depth) numpy work and no Python loop over tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ctrltok.udfs import by_value
from pyspark.sql.types import IntegerType


def max_depths(heads_lists) -> np.ndarray:
    lens = np.fromiter((0 if h is None else len(h) for h in heads_lists), dtype=np.int64, count=len(heads_lists))
    out = np.zeros(len(lens), dtype=np.int64)
    total = int(lens.sum())
    if total == 0:
        return out
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    flat = np.concatenate([np.asarray(h, dtype=np.int64) for h in heads_lists if h is not None and len(h)])
    owner_start = np.repeat(starts, lens)
    owner_len = np.repeat(lens, lens)
    idx = np.arange(total, dtype=np.int64)
    if np.any(flat >= owner_len):
        raise ValueError("head index outside its sentence")
    is_root = flat < 0
    parent = np.where(is_root, idx, owner_start + flat)
    dist = (~is_root).astype(np.int64)
    for _ in range(int(np.ceil(np.log2(max(int(lens.max()), 2)))) + 2):
        grand = parent[parent]
        if np.array_equal(grand, parent):
            break
        dist = dist + dist[parent]
        parent = grand
    # converged pointers must end at real roots; a cycle collapses onto itself
    if not np.array_equal(parent[parent], parent) or not np.all(is_root[parent]):
        raise ValueError("heads contain a cycle")
    nonempty = lens > 0
    out[nonempty] = np.maximum.reduceat(dist, starts[nonempty])
    return out


@F.pandas_udf(IntegerType())
def _max_depth_udf(heads: pd.Series) -> pd.Series:
    return pd.Series(max_depths(list(heads)), dtype="int32")


def max_depth(heads) -> Column:
    """Edges from the root to the deepest token (0 for a single token or no tokens)."""
    return _max_depth_udf(F.col(heads) if isinstance(heads, str) else heads)


# Ship this module's UDF code with the UDF itself (pickle by value), so Python
# workers need only numpy/pandas, not an installed copy of this package.
by_value(__name__)
