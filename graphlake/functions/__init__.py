"""Functions beside the graph operators."""
