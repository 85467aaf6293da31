"""Readers of Markdown corpora, archives, link lists and relevance sets."""
