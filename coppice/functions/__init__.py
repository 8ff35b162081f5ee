"""Column expressions: masks, leaf losses, scores."""
