"""Whole jobs made of the operators."""
