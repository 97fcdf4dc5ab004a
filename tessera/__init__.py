"""tessera: a PySpark-native analytics engine.

Queries and operators are functions from DataFrames to DataFrames; Catalyst and AQE choose the physical plans.
"""
