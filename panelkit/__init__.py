"""Panel time-series analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in tasks travel with the task, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
