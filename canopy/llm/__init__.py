"""Operators for preparing language-model training data. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
