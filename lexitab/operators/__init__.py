"""Relational operators: pairing, gains, ranks, statistics, de-duplication."""
