"""plans of kronoweft."""
