"""Additive decomposition and temporal analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions with the tasks, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
