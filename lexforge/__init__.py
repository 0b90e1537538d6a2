"""lexforge: retrieval analytics over contract corpora as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that these need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
