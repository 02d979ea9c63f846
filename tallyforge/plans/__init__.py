"""Set-based jobs composed from the operators."""
