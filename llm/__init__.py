"""Training-data operators: one module per operator, queries registered in ``registry``.

Nothing outside this package imports it.  The package is pickled by value so
that executors need not have the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
