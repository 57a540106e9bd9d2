"""feedlens — customer-feedback sentiment analytics as lazy Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; nothing inside an operator
collects to the driver.  Sub-packages:

* ``functions``  column-expression building blocks (label vocabulary, polarity maps, tokenizer, time)
* ``sources``    schemas, readers, sinks and the fixture views over the driver's tables
* ``operators``  normalisation, scoring, filters, aggregates, rankings, rules, metrics
* ``streaming``  Structured Streaming versions of scoring, time series and spike alerts
* ``plans``      the registered query catalogue (Spark plan + DuckDB oracle SQL per operator)
"""

__version__ = "0.1.0"

# Python workers (mapInPandas in C2 and T1) receive feedlens functions by value, so they need no
# access to this package's files on executors.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to importing on workers
    pass
