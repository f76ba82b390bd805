"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Every operator selects the columns it needs by name first, so
further columns of its input, whatever their names, neither clash with its own nor reach its result unless it says so.
"""
