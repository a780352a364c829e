"""Column expressions and the few per-document kernels that they can't express."""
