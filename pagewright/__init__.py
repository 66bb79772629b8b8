"""Spark-native analytics for scanned and structured documents."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that
# executors need neither the repository on their path nor a shared working folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
