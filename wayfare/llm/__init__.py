"""Training-data operators: dedup, quality, decontamination, PII, extraction, mixing, language, tokens, URLs."""
