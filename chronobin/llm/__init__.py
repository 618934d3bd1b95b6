"""Training-data operators: near-dedup, mixing, tokenising, scoring, sharding, filters, media, licences, archives."""
