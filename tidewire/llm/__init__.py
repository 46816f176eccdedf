"""Operators for preparing the texts that language models are trained on. Nothing outside this package imports it."""
