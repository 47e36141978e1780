"""Operators of a training-data pipeline over document tables.

Functions of this package that run inside tasks travel with their
closures (pickled by value), so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
