"""Operators for large-scale training-data preparation, and the queries over them.

Nothing else in the library imports this package. Functions of this package that
run inside Spark's Python workers are pickled by value, so executors need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
