"""Spark-native data engine for a media upload and conversion service.

Every batch operator is a plain function ``DataFrame(s), params -> DataFrame``
built from DataFrame / SQL expressions so Catalyst can prune, push down and
plan it.  Stream forms live in :mod:`reelspark.streaming`.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python kernels travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
