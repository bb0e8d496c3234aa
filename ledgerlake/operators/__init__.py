"""Operators on bills, clauses, hits, judgements and scores."""
