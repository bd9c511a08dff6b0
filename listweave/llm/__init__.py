"""Operators for preparing training text, with their queries in ``queries``.

Nothing else in the package imports this folder.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# The code of this folder travels with the tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
