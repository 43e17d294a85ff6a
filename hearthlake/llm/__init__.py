"""Training-data operators: near-duplicates, personal data, quality, language, tokens, pages, leaks, chats, toxicity."""
