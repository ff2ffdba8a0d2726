"""ledgerwatch: Spark jobs for transaction-fraud analytics."""

__version__ = "0.1.0"
