"""trellisq: practice analytics and training-data operators on PySpark.

Every operator is a function from DataFrames to a DataFrame. The package is
shipped to Python workers by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
