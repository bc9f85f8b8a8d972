"""Training-data operators (HTML text, toxicity, language models, sharding, tokens, dedup)."""
