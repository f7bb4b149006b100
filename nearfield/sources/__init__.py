"""Readers of vectors and durable collections."""
