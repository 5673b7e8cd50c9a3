"""pawl: a quality-ratchet analytics engine on PySpark DataFrames."""
