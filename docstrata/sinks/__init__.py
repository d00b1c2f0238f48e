"""Writers: content-addressed archive, idempotent tables, feeds, index dumps."""
