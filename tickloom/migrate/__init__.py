"""Translation of q expressions to the dialect, and table definitions for other engines."""
