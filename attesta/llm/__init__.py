"""Operators of a training-data pipeline over document, page, conversation and benchmark tables."""
import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the query, so executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
