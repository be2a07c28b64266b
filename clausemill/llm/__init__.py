"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it.  Functions that run in Spark's Python
workers are pickled by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
