"""Operators for training-data pipelines: scoring, deduplication, packing, search.

Nothing else in the library imports this subpackage. Functions that run inside
Python tasks are shipped to the executors by value, so a cluster needs only the
third-party libraries installed, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
