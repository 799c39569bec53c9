"""Operators for preparing text corpora at scale.

Every operator takes and returns DataFrames. Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Tasks carry the code they run, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
