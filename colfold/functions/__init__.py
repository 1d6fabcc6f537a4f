"""Column expressions of models, residuals and reconstruction."""
