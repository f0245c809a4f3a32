"""Subpackage of Tessera."""
