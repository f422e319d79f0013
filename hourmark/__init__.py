"""hourmark: leakage-safe time-series analytics as Spark DataFrame transforms.

Every operator takes DataFrames and column names and returns a lazy DataFrame;
nothing here collects data to the driver or runs Python per row.
"""

__version__ = "0.1.0"
