"""corvane: document preparation, hybrid retrieval, ranking and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__all__ = ["__version__"]
__version__ = "0.1.0"

# Functions sent to executors carry this package's code with them, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
