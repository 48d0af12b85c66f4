"""Column functions over boxes, cells and paragraphs."""
