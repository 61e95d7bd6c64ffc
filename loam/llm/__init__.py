"""Training-data operators: filters, scans, de-duplication, search, packing, tokens and dialogue rendering.

One module per operator; each holds the general operator (DataFrame in, DataFrame out), the thin
registered query over the driver tables and, where SQL can say it, the DuckDB text. ``queries.py``
gathers them. Functions that run in Python workers are pickled by value, so executors need no
install of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
