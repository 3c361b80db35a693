"""Composite jobs built from the operators; each answers for all users in one plan."""
