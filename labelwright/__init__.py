"""Label-quality curation of rated text as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need not have the package: its few functions that run there are sent whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOMAIN = (1.0, 2.0, 3.0, 4.0, 5.0)
SEED = "42"
MIN_CHARS = 10
