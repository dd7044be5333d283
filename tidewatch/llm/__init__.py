"""Operators for preparing text corpora: dedup, filters, tagging, counting, packing, search.

Nothing else in the library imports this subpackage. Code that runs in Python tasks
travels with the task, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
