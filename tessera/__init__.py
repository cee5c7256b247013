"""Analytics over registries of licences and the training-data operators, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
