"""Sources: the given test tables, landed feed files, the derived warehouse."""
