"""loam: Spark DataFrame operators for response, evaluation and activation tables."""

import sys as _sys

__version__ = "0.1.0"

# Python workers on executors need not have this package installed: functions
# handed to pandas UDFs / mapInPandas are shipped by value with the task.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
