"""Part of the half-life engine."""
