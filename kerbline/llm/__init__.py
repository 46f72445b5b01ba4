"""Operators for training-data pipelines over whole text tables. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to Python workers by value, so a session needs no --py-files for them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
