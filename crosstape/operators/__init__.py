"""Relational operators: ranks, selection, outcomes, as-of joins, evidence, books."""
