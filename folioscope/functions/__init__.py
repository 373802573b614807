"""Column functions: text, similarity, identifiers, dates, names."""
