"""Operators for cleaning and encoding a language-model training corpus."""
