"""Part of kvloom."""
