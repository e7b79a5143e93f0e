"""Map layers as DataFrames, and thin renderers of them."""
