"""Training-data operators: language id, tokenisation, secrets, near-duplicates, packing, media, quality, WARC and LM scoring.

Nothing outside this subpackage imports it.
"""
