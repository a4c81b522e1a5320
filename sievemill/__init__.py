"""sievemill: data quality, rules, synthetic data and telemetry analytics on PySpark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors with the task, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
