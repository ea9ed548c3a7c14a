"""Spark jobs that turn unstructured log lines into queryable tables.

Importing the package also tells PySpark to ship its task-side helpers by
value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
