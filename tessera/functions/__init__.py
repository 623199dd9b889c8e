"""Predicates and small expression builders."""
