"""Spark-native analytics over labelled frames, road masks and video telemetry."""

import sys

from pyspark import cloudpickle

# The few Python steps travel inside their plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
