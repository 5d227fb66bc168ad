"""Operators of a training-data pipeline: deduplication, filtering, mixing and packing of documents.

Nothing outside this subpackage imports it. Functions that run inside Spark tasks are sent to
the executors by value, so a cluster needs numpy, pyarrow and the libraries an operator
names, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
