"""Training-data operators: each module holds one operator and its documented edge cases."""
