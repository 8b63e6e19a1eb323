"""Natural-hazard impact analytics as lazy PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel to the executors with the plan, so that the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
