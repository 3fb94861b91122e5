"""Column functions: text, URLs, numbers, JSON, language and classification."""
