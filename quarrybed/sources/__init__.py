"""Sources: binary and text artifacts as DataFrames."""
