"""Column expressions and string kernels."""
