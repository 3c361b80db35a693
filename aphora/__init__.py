"""aphora: engagement analytics for short-text catalogues, as plain Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the code they use, so that executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
