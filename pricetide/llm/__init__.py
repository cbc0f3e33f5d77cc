"""Training-data operators: packing, mixing, search, scoring, encoding, near-duplicates, safety.

Nothing else in the library imports this subpackage. Its functions travel to
the executors by value, so a cluster needs the libraries they use but no copy
of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
