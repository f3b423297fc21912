"""millrace: a PySpark-native metrics-flow engine.

A flow graph over canonical events is compiled into lazy DataFrames; nothing
runs until a tile, a table or a query result is asked for.
"""

__version__ = "0.1.0"
