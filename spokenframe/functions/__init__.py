"""Column functions over text and numbers."""
