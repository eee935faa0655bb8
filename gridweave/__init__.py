"""gridweave: hierarchical block analytics of pairwise-interaction matrices on Spark.

Everything is a function from DataFrames to a DataFrame.  The only values that
reach the driver are one-row metadata (domain box, counts, chosen depth) and the
scalars of the power method.
"""

import sys

from pyspark import cloudpickle

from gridweave.grid import Grid

# Functions that run inside tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Grid"]
