"""Website, document and search-visibility analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
