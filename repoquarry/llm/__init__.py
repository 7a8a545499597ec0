"""Operators for training-data pipelines: scans, dedup, packing, scoring and filtering of document tables."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value, so that those need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
