"""Ledger-history analytics and lookup operators for Apache Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel with the job, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
