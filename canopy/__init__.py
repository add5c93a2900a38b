"""Search and change tracking over large hierarchical namespaces, on Spark DataFrames."""
