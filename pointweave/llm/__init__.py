"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

The operators' functions travel to the executors by value, so these need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
