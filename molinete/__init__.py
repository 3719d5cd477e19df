"""Spark-native analytics for a membership business with a point of sale.

Every operator is a function from DataFrames to DataFrames with keyword-only
parameters. "Today" is always an explicit ``as_of`` date; money stays in
``DecimalType`` from scan to sink.
"""
