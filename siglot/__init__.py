"""Spark-native safety-surveillance and lot-quality analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster
# needs only PySpark and the scientific libraries, not an installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
