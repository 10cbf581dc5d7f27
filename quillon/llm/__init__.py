"""Operators for training-data corpora: documents in, decisions and digests out."""
