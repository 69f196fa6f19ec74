"""Column expressions: text, dates, URLs, keys and VARIANT access."""
