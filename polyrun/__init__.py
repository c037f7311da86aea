"""polyrun: homopolymer tract-length analytics on Spark DataFrames."""
