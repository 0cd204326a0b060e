"""Safe expressions, path queries and rule documents."""
