"""Analytics over change histories and training corpora, as PySpark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
