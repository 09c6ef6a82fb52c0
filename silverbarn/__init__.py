"""silverbarn: a Spark-first engine for financial and housing data.

Importing the package does not start Spark; every operator takes and returns
lazy DataFrames.
"""

__version__ = "0.1.0"
