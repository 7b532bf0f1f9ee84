"""placerank: place-review analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame; nothing is evaluated until the caller runs an action.
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "models", "streaming"]

# Functions of this package run inside Python workers (pandas UDFs, mapInPandas).  Ship
# them by value so executors need no installed copy of the package.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
