"""Timed-media and transcript analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get the package's Python functions with the task: it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
