"""Retail time-series analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Helpers travel to the executors inside the pickled function, so a cluster needs no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
