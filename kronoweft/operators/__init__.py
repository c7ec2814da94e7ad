"""operators of kronoweft."""
