"""Column builders: text, money, identifiers, pack sizes, URLs, scores."""
