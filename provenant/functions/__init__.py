"""Column functions on URLs, texts and numbers."""
