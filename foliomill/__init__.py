"""foliomill: a Spark-native engine for document-text analytics.

Documents, pages and recognised text blocks are typed DataFrames; every operator is a function from
Columns to Columns or from DataFrames to DataFrames, so that Catalyst plans the whole pipeline.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package go to Python workers by value, so executors needn't have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
