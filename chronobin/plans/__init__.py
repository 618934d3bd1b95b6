"""Logical queries over event tables and the predicates they become."""
