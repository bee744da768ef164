"""Training-data operators: deduplication, tokenisation, packing, language ID, PII, chat formatting."""
