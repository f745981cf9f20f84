"""Part of lodeleaf; see README.md."""
