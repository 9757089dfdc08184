"""Operators for language-model data: self-contained, imported by nothing else in the package."""
