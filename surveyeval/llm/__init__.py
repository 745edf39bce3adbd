"""Operators for preparing large training-text corpora.

Nothing outside this subpackage imports it.  The functions that run inside Python workers are pickled
by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
