"""Spark-native analytics for long-read focal amplifications: interval joins, breakpoint graphs, walks and scores."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions it hands to Spark travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "1.0.0"
