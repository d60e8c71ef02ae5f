"""The catalogue of named queries with their SQL counterparts."""
