"""SQL statements that state what each registered query must return."""
