"""Query grammar, its compilation to columns, and distributed numbering."""
