"""Tessera: a multimodal feature, scoring and corpus engine expressed in PySpark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
