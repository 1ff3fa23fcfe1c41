"""Part of the tianguis package."""
