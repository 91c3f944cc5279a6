"""Training-data operators: one module per operator, the shared byte and table helpers, and their registered queries.

Functions of this package run inside Python workers. They are shipped by value, so that executors need no copy of it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
