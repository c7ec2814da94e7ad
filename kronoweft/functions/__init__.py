"""functions of kronoweft."""
