"""lodeleaf: set-based document retrieval and corpus processing on PySpark.

Every operator takes and returns DataFrames; the physical strategy is left to
Catalyst and adaptive execution.
"""
