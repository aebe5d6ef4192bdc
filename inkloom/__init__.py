"""Inkloom: a PySpark-native engine for building, deduplicating and linking document catalogs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
