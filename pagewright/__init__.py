"""Page-resource analytics and training-data operators, written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with their code: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
