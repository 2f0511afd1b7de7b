"""Composite queries built from the operators, and the named-query catalog."""
