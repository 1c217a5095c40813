"""Operators for building training data: filtering, de-duplication, scanning, packing."""
