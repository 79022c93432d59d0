"""terrane: OpenStreetMap-style entity analytics, planned as PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
