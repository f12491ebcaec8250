"""archspark: source-code corpus analytics as PySpark DataFrame operators."""

from archspark.schema import KEYS

__all__ = ["KEYS"]
