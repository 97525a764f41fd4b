"""A Spark-native document-knowledge engine: chunking, vector and graph retrieval, hybrid search."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel by value, so executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
