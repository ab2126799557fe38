"""flowsentry: network-flow detection analytics as PySpark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
