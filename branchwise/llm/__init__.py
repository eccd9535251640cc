"""Training-data operators: one module per operator, their queries in ``queries``.

Functions of this subpackage that run in Python workers are sent to them by value, so executors
need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
