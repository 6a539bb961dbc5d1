"""Analytics over operational logs and metrics, written as PySpark DataFrame operators."""
