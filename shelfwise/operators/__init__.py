"""Operators: pure ``DataFrame -> DataFrame`` functions, one module per family."""
