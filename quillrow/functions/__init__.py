"""Deterministic pieces: column expressions, prompts, schemas and validators."""
