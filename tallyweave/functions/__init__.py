"""Column builders: scalar rules and fuzzy scores."""
