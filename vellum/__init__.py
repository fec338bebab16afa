"""A review engine and corpus operators on Spark. Functions go to the tasks by value, so executors need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
