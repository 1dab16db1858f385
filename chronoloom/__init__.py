"""chronoloom: time-aligned score data and training-corpus operators on Spark DataFrames."""
