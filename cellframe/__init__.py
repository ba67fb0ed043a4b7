"""cellframe: tables of scalar, string, complex and tensor cells on Spark DataFrames."""
