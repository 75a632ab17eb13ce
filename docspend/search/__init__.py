"""Text and vector search."""
