"""Analytics over recorded streaming runs of token servers, as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the job: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
