"""Operators for the preparation of language-model training data.

Functions of this package that run in tasks travel with the job, so that executors need no copy of
the package on their Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
