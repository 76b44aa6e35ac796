"""Operators of a training-data pipeline: deduplication, filters, tokens, shards, archives.

Nothing else in the package imports this one. Every operator takes DataFrames, names its
columns by parameter and ignores further columns of its input.
"""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
