"""Column functions and the fixed vocabularies they use."""
