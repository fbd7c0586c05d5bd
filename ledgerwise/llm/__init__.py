"""Training-data operators: dedup, packing, PII, language ID, decontamination, quality, chat, URLs, tokens."""
