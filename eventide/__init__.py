"""Event-signal analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Small helpers used inside pandas UDFs travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
