"""Claims as a stream."""
