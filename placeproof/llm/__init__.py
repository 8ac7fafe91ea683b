"""Operators for preparing training text: dedup, sharding, classification, search, packing and archives. Nothing else imports it."""
