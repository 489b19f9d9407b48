"""Operators for large training corpora, one module each; nothing else in the library imports them."""
