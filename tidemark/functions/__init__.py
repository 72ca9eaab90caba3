"""Column functions that more than one operator uses."""
