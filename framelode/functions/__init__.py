"""Scalar column functions: text, coercion of loosely typed values, vectors."""
