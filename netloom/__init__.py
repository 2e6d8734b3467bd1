"""Design analytics on Spark: catalogs of hardware sources, waveforms and run logs as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
