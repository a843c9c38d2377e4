"""Document-evidence analytics as PySpark DataFrame operators."""

from attesta.session import get_spark, ship

__all__ = ["get_spark", "ship"]
