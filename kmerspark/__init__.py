"""kmerspark: k-mer analytics and in-silico PCR on Spark DataFrames."""
