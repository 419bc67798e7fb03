"""Spark-native document-library analytics.

Workers need no copy of this package: its functions travel to them by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
