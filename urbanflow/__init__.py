"""Analytics for urban drainage networks on Spark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value, so no executor needs the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
