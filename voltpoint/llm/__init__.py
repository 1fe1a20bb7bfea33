"""Operators for the preparation of text corpora; nothing else imports them."""
