"""A PySpark-native engine for streams of sequencing reads."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run on executors travel with their tasks, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
