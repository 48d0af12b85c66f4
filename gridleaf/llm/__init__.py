"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator module has
a general interface; ``queries`` binds them to the synthetic tables.
"""
