"""Event-log analytics on Spark: DataFrame operators over partitioned, ordered logs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
