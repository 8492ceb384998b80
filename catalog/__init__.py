"""The operators as queries on the driver tables, with their SQL twins."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
