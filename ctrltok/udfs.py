"""Serialisation of the library's pandas UDFs.

PySpark pickles a UDF's function with cloudpickle, by reference when its
module is importable on the driver.  Executors would then have to import this
package.  Registering the (few) UDF modules for pickling *by value* ships
their code inside the task instead, so a cluster needs only numpy and pandas.
"""

from __future__ import annotations

import pickle
import sys
import weakref
from collections.abc import Callable

import numpy as np


def by_value(module_name: str) -> None:
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - very old pyspark
        return
    register = getattr(cloudpickle, "register_pickle_by_value", None)
    if register is not None:
        register(sys.modules[module_name])


_SHARED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared(value) -> Callable:
    """``() -> value`` for the body of a UDF.  The value is broadcast once, so a Python worker holds it once, whatever the number
    of UDFs and tasks that use it (in a UDF's closure each UDF of each task would load a copy).  It travels pickled as
    the UDFs are, so executors need not import this package."""
    from pyspark import SparkContext, cloudpickle

    context = SparkContext._active_spark_context
    if context is None:
        return lambda: value
    known = _SHARED.get(value)
    if known is None or known[0] != context.applicationId:
        known = _SHARED[value] = (context.applicationId, context.broadcast({"pickled": cloudpickle.dumps(value)}))
    return _opener(known[1])


def _opener(sent) -> Callable:
    def value():
        held = sent.value
        if "value" not in held:
            held["value"] = pickle.loads(held.pop("pickled"))
        return held["value"]

    return value


def bounded_ranges(sizes: np.ndarray, most: int):
    """Ranges ``(lo, hi)`` of consecutive rows whose sizes sum to ``most`` at most (a larger row alone)."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi
        lo = hi


by_value(__name__)
