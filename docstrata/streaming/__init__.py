"""Stateful operators, for batches and for streams."""
