"""Conversation-memory analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
