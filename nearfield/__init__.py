"""nearfield — content-based item similarity on Spark.

Item text completeness tiers, enrichment from landed search responses,
embedding (pluggable batch encoder or built-in hashing encoder), an
inverted-file vector index, exact and approximate nearest-neighbour search,
and run reports — all as DataFrame plans.

Functions of this package that run inside tasks (Arrow kernels, encoder
hooks) are shipped by value with the task, so executors need no install of
the package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
