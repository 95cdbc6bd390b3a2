"""Training-data pipeline operators (URL filter, dedup, licences, tokens, mixing, search)."""
