"""Reconcile records with external evidence on Spark, and prepare text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so that a
# cluster needs no copy of the package on its workers' paths.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
