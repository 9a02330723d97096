"""Whole reports built from the operators."""
