"""Column expressions: text, numbers, calendar. No Python UDFs."""
