"""Operators that prepare training corpora: cleaning, near-duplicate search, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
