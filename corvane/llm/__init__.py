"""Operators for training-data pipelines. Nothing outside this package imports it."""

import corvane
from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(corvane)
