"""Column-level helpers: predicates, numeric/label formatting, parsers."""
