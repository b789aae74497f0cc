"""Listings and recruiting-event analytics expressed as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers receive the helpers of this package with the task instead of
# importing them, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
