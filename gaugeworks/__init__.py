"""Environmental-statistics operators for Spark DataFrames.

Every operator takes a DataFrame plus the names of its key, order and value
columns, and returns a lazy DataFrame, so one call serves any number of
stations, gauges, regions or networks at once.
"""
