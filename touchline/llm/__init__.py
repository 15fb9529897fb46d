"""Operators over training documents. Nothing outside this subpackage imports it."""
