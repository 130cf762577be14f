"""Operators for preparing large text corpora. Nothing outside imports this package."""

import sys

from pyspark import cloudpickle

# Functions travel to executors as a whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
