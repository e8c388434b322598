"""Operators for training-data pipelines: cleaning, deduplication, scoring, tokens.

Tables are read as they are: a null text counts as an empty one, rows that repeat
give rows that repeat, and columns an operator does not need are never read.
"""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
