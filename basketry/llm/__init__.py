"""Operators for training data: pairs, quantiles, heavy hitters, sequences, tokens, packing, quality."""
