"""Operators that prepare language-model training data; nothing outside this folder imports them."""
