"""Column builders: each takes and returns Columns, so batch and streaming plans share them."""
