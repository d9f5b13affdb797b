"""lexatlas: document retrieval, evidence and answer analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame.  Nothing is
executed until the caller writes or collects, except where a size has to be
checked before data is broadcast.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so an executor needs no copy
# of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
