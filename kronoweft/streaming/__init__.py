"""streaming of kronoweft."""
