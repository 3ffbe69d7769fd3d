"""citelab: a PySpark-native engine that measures how answers surface and cite web sources.

Functions of this package that run on Python workers are sent by value, so executors need no
installed copy and a worker started on a fresh machine behaves like the first one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
