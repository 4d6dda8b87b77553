"""Stream operators: deduplication, batches, rate limits, idempotency."""
