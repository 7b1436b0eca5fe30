"""Document-tree indexing on Spark: flat, ordered DataFrames of pages, sections and nodes."""
