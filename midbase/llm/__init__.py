"""Training-data operators: each module holds one operator and the thin query built on it."""
