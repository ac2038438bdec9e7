"""Writing a graph: JSON, diagrams and Markdown pages. Names, types and counts only, never data values."""
