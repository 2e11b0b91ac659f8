"""Operators for training data of language models."""
