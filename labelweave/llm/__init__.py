"""Operators for training-data pipelines at corpus scale."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
