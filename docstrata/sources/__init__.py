"""Readers: daily summaries, bodies, consolidated texts, configuration, archives."""
