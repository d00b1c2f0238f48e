"""Column functions: text, dates, identifiers, geometry."""
