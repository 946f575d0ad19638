"""Sources: which tables, how they are read, and where a read begins."""
