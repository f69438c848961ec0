"""Training-data operators: mixing, near-duplicates, licences, tokens, chat, search, toxicity, lines."""
