"""Operators for large training-text corpora; nothing else in strandlog imports this subpackage."""
