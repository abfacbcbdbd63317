"""deskflume: desk, knowledge and catalog analytics as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
