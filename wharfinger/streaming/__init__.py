"""The same work on streams; the batch operators remain the reference."""
