"""Operators for preparing training data at corpus scale.

Self-contained: no other part of the library imports this subpackage.
"""
