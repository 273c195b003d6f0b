"""A relational table engine on PySpark, with operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, wherever this package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
