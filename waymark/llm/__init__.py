"""Operators for building training corpora out of a table of documents.

Functions that run on executors are pickled by value, so an executor needs no
copy of this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
