"""Listing and posting analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# The page parser travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
