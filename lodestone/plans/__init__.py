"""Query specifications and how they are lowered to DataFrames."""
