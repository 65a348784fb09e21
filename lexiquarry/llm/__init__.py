"""Training-data operators. Nothing else in the library imports this package.

Functions of this package that run on executors travel by value, so executors need
no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
