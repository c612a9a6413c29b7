"""Operators for large text and vector corpora.

Tasks of this package are shipped to the executors by value, so a cluster needs no
copy of it; nothing else in the library imports it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
