"""spendlens: a Spark-native engine for bank-transaction data.

Statement ingest, expanding per-user features, isolation-forest anomaly
detection with explanations, relational text classification, evaluation,
model registry, listings and analytics -- all as DataFrame operators.
"""

import sys as _sys

try:  # ship our pandas-UDF code with the closures, so workers need no install
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
