"""jsonloom: JSON analytics, retrieval and large-table data processing on PySpark DataFrames."""
