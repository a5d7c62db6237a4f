"""centime: personal-finance ledger and analytics operators on Spark.

Every operator is a function from DataFrames to a DataFrame; nothing is
computed per user on the driver.  See README.md for the operator map.
"""

__version__ = "0.1.0"
