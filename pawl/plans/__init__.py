"""Whole computations built from sources and operators."""
