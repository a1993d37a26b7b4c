"""Operators for training data: splits, samples, overlaps, pair defects, packing, cuts, leaks, mixes, abuse."""
