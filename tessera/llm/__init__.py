"""Operators for corpora that train language models; nothing else in the library imports them."""
