"""Operators for preparing training data: documents, pages, labels.

Functions that run in Python workers are pickled by value, so executors need only the
installed libraries and not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
