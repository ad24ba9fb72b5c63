"""Sources: bindings of stored tables to the relations that operators work on, and readers of files."""
