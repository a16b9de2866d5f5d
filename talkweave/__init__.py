"""talkweave: conversation-data operators for Spark.

Everything here is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so a cluster
# needs no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
