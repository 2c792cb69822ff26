"""Operators for preparing text corpora; nothing else in the package imports this folder.

The functions here that run in Python workers are sent to them by value, so
executors need the public libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
