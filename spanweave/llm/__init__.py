"""Operators for preparing training data: documents and conversations at scale."""
