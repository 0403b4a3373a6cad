"""Spark-native sampling and analytics over volumes, label fields and spatial graphs."""

import sys

from pyspark import cloudpickle

# Kernels travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
