"""Query families composed from the operators."""
