"""Operators of a training-data pipeline on Spark.

Functions that run inside tasks are shipped with the job, so executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
