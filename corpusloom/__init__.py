"""Corpus preparation, profiling, sentence graphs and summary evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
