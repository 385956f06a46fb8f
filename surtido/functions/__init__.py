"""Column expressions: coercion, calendar features, texts."""
