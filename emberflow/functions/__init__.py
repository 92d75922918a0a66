"""Part of emberflow."""
