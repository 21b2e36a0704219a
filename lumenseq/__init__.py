"""Learner-sequence analytics expressed as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the small per-row helpers with each task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
