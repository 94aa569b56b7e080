"""waystone: trajectory analytics on PySpark DataFrames."""
