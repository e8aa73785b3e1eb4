"""Operators for preparing training data; nothing else in the package imports them.

Their task functions travel to the executors by value, so that a cluster needs no copy
of this package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
