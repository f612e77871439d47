"""reelsift: a PySpark-native engine for cataloguing, scoring and de-duplicating media libraries."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers are sent by value, so that executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
