"""Complete reports composed from the operators, and the query registry."""
