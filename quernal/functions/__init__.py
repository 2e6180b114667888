"""Column functions: tokens, query classes, paths."""
