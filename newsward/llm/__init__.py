"""Operators for training-data pipelines: extraction, search, dedup, scoring, mixing, packing.

Nothing else in the library imports this package. Functions that run inside tasks are
sent to the executors by value, so executors need no copy of the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
