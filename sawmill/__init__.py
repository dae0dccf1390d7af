"""Log-template analytics and training-data operators on Spark DataFrames."""
