"""lexiquarry: document-corpus analytics written as Spark plans.

Functions that run on executors travel by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
