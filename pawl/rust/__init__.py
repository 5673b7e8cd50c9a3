"""Rust source text to measurements, in plain Python; pawl.functions.source wraps it for Spark."""
