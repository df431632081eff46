"""Field files, the result cache and step checkpoints."""
