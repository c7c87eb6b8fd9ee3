"""Table models and the registered queries."""
