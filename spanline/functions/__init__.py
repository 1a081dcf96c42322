"""Part of spanline."""
