"""Training-data operators (one module per operator) and their queries.

Worker functions of this package are pickled by value, so executors need
only numpy/pyarrow, not this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
