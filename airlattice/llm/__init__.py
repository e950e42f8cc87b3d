"""Operators for training data: search, packing, quality, tokens, near copies, language and toxicity."""
