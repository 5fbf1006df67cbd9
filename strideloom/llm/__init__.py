"""Operators for large training-text pipelines. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel whole, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
