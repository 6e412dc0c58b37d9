"""corpusloom: a PySpark-native engine for technical-document corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: they need no copy of it installed.
# What runs there therefore names functions, not modules of this package, which would travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
