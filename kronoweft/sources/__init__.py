"""sources of kronoweft."""
