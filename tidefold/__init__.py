"""Incrementally maintained aggregate views on Spark.

Python functions that run on executors are shipped by value, so a cluster's workers need not have the package
on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
