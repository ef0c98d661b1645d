"""Training-data operators: mixing, chat formatting, dedup, quality, extraction, toxicity, decontamination, token counts."""
