"""keymere: keyed entity collections as Spark DataFrames."""
