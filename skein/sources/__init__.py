"""Part of skein: sources."""
