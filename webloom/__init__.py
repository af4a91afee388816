"""webloom: Spark-native extraction, storage and analysis of collected web pages.

The package is pickled by value, so Python workers need no copy of it on their
own module path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
