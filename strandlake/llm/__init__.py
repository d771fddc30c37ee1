"""Operators for preparing training data. Nothing outside this subpackage imports it."""
