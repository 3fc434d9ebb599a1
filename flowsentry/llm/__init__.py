"""Operators for preparing language-model training data.

Ten operators, one module each, a registry of their queries (``queries``) and
general helpers (``common``). Nothing outside this subpackage imports it.
"""
