"""Spark-native operators for line-aligned source/target text corpora.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; the
heavy lifting is done by Spark expressions, joins and aggregations, with an
Arrow-batched pandas UDF only where Spark has no equivalent (edit similarity,
tree depth over a heads array, embedding block maxima).
"""

from ctrltok.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
