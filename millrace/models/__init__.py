"""Tokenizers and the boundary to models."""
