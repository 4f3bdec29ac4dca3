"""Operators for preparing training text: filters, duplicates, languages, tokens, chat and packing."""
