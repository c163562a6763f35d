"""Training-data operators: mixing, licences, BPE, near-duplicates, token shards, sharding, chat, toxicity, fingerprints, search."""
