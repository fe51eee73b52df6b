"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Workers get these functions by value, so they need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
