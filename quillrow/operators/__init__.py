"""The kinds of steps."""
