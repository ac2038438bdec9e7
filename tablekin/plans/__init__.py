"""From tables or files to a graph: the passes put together."""
