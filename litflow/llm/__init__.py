"""Training-data operators: mixing, language, chat, fingerprints, secrets, near copies, tokens, leaks, repeats, urls."""
