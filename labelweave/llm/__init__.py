"""Operators that prepare text for model training. Nothing outside this subpackage imports it."""
