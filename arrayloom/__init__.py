"""arrayloom: repeat-array and spacer-targeting analytics as Spark jobs."""

from pyspark import cloudpickle
import sys

# Functions used in Python tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
