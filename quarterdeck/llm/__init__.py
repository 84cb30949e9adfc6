"""Operators for cleaning and packing large text corpora."""

import sys

from pyspark import cloudpickle

# tasks get the functions themselves, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
