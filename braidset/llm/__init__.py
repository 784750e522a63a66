"""Operators of a training-data pipeline; nothing outside this folder and its callers imports them."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its Python functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])
