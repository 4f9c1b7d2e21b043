"""Column functions: text, strict casts, identifiers, policy."""
