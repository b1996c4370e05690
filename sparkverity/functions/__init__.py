"""Column builders: text, hashes, image scores, numbers."""
