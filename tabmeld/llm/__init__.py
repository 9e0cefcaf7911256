"""Operators for preparing training text: sharding, quality, near copies, licences, and more."""
