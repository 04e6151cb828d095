"""Column expressions, fixed rule values and small numeric helpers."""
