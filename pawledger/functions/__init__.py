"""Column builders, rule tables and period helpers."""
