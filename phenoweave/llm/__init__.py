"""Operators for large training-text pipelines.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered ``opN_*`` queries; every operator lives in a module of its own.
"""
