"""The named queries over the standard tables, each with its SQL where SQL can express it."""
