"""Late data as streams: an extension; what it does per batch is the batch engine's own upsert."""
