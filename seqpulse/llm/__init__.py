"""Operators for language-model training data. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
