"""Operators for preparing training text: nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
