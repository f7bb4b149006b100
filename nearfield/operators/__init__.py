"""Exact search, evaluation, quantizers and indexes."""
