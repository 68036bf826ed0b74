"""Column expressions over text, URLs and instant tools."""
