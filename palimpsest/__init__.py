"""Spark jobs over libraries of versioned texts: selection, retrieval, diff, rates and run logs."""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package by value: nothing to install on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
