"""Operators of a training-data pipeline, and their queries. Nothing else in the library imports this package.

Functions of this package travel to Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
