"""Column expressions and small numeric kernels."""
