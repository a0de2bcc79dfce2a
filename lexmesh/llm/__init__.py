"""Training-data operators: quality, deduplication, decontamination, mixing, tokens, language models, pages.

Nothing outside this subpackage imports it.
"""
