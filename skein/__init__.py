"""skein: a document and vector analytics engine on Spark DataFrames."""
