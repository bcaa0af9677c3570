"""Ledger analytics as Spark DataFrame jobs: Bronze text rows to Silver star schema to Gold views."""

import sys

from pyspark import cloudpickle

# Functions of the package travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
