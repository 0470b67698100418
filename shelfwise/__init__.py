"""Product categorisation on Spark: cleaning, profiling, features, topics,
clusters, weak labels, semi-supervised learning and its metrics."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need only
# pyspark, numpy, pandas and pyarrow, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
