"""Column-level building blocks: pure expressions, no jobs, no Python workers."""
