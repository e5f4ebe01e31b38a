"""PySpark library for building, maintaining and searching a document corpus as tables."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel by value, so that workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
