"""Harbor: finds ports in vessel position reports with Spark DataFrames."""
