"""causeway: incident-correlation analytics on PySpark DataFrames."""
