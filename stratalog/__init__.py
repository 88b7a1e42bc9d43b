"""Spark-native analytics over content-addressed version history.

Worker processes get this package's functions by value, so that a job runs on a
cluster whose executors do not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
