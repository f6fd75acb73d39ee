"""Part of cindertally."""
