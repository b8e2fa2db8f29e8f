"""Operators for preparing training text and their registered queries.

Task code travels with the job: functions of this subpackage are pickled by value, so that executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
