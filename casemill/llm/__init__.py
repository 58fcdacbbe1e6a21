"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; every other module is one operator with its own general interface.
"""
