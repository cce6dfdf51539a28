"""Column expressions: no Python runs on rows."""
