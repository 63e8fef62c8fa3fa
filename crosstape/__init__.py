"""Point-in-time, cross-sectional market research as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task code from this package travels with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
