"""Evaluation, mutation and expansion of generated SQL, as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
