"""The queue and the outbox kept up to date from streams."""
