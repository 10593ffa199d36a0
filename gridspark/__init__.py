"""Depth-map analytics on Spark: frames, pixels and result tables as DataFrames."""

import sys

from pyspark import cloudpickle

# The small numpy helpers travel inside the tasks, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
