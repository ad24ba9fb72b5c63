"""Spark-native analytics over repositories of documents and their histories."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# What runs on executors is sent whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
