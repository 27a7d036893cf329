"""Operators for preparing training data; `queries` registers them. Nothing outside this
subpackage imports it."""
