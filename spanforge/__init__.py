"""Interval-labelled sequence analytics and classifier evaluation on Spark."""

import sys

from pyspark import cloudpickle

# Functions handed to pandas workers travel by value, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
