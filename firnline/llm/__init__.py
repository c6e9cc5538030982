"""Operators for preparing training data; nothing else in firnline imports them."""
