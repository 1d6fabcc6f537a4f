"""SQL over folded files, and filters that reach them."""
