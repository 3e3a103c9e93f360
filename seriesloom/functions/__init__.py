"""Column expressions; nothing here triggers a job or runs Python per row."""
