"""Folioscope: hybrid retrieval over long structured documents, as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
