"""Training-data operators: sharding, language, token files, mixing, scoring, search, chat, near copies."""
