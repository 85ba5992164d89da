"""Part of skein: plans."""
