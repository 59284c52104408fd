"""Column functions: predicates, features, distributions."""
