"""Column builders and small scalar helpers."""
