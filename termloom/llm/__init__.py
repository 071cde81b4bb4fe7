"""Operators for training-data pipelines: chat, quality, privacy, duplicates, packing."""
