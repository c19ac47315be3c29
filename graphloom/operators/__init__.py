"""Solution algebra, closures, spatial joins, vector search and run analytics."""
