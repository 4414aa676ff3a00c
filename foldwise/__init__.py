"""foldwise: leak-free feature preparation, profiling and evaluation on Spark.

Every operator is a function from DataFrames to DataFrames.  Fitted state is a
small table, never a driver-side dictionary, and nothing depends on row
position: operators take explicit key columns, and order columns where order
matters.
"""
