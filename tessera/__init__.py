"""A Spark-native analytics engine for path-addressed knowledge stores."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
