"""geolith: a Spark-native analytics engine for point clouds and tetrahedral meshes."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so a cluster's workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
