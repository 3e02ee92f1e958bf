"""Operators for building language-model training data; the rest of the library never imports this."""
