"""Sentiment analytics on large text collections, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: the few Arrow functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
