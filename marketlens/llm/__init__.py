"""Operators of a training-data pipeline: shards, scores, scans, filters, packs."""
