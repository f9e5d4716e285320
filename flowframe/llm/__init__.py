"""Operators for preparing training text: filters, tokenisation, packing, near duplicates, quality."""
