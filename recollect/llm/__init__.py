"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries. Functions sent to executors
are pickled by value, so executors need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
