"""tessera: analytics over versioned, content-addressed collections, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel with their plan: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
