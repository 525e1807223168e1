"""Operators for preparing training corpora: scanning, scoring, tokenising, de-duplicating, packing."""
