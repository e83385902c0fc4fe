"""veilum: sensitive-text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python code that runs on executors is shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
