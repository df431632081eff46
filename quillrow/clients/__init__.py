"""Model clients."""
