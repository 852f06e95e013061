"""corpusmith: a PySpark-native engine for cleaning, modelling and reporting on text corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors needn't have the package: functions that run there travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
