"""Lumenframe: a PySpark-native analytics engine.

Every operator is a DataFrame, SQL or Structured Streaming construct, so that
Catalyst, Tungsten and adaptive execution choose the physical plan.
"""

__version__ = "0.1.0"
