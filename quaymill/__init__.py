"""Quaymill: a Spark-first analytics engine for station-level transit demand.

Functions that run in Python workers are sent by value, so that executors need the libraries they
use but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
