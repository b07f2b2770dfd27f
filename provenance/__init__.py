"""Media-provenance analytics on PySpark: operators are functions from DataFrame to DataFrame, plans name queries made of them."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
