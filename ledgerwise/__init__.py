"""Set-based wallet-risk analytics on transfer ledgers, written for Spark.

Every operator takes whole DataFrames and returns a DataFrame for all wallets
at once.  Time-dependent operators take an explicit ``as_of`` (unix seconds).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions for the workers travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
