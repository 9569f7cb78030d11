"""Column helpers and driver scalars."""
