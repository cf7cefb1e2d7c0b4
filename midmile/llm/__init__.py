"""Operators for building training data; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of this package
