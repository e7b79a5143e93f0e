"""Network-constrained spatial clustering, and training-data operators, on Spark."""
