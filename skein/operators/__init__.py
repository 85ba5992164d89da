"""Part of skein: operators."""
