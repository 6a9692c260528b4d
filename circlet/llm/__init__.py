"""Operators for preparing training corpora at scale: mixing, de-duplication, filtering, search and tokenisation."""
