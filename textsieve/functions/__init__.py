"""Pure column expressions: Column in, Column out. They run unchanged on streaming DataFrames."""
