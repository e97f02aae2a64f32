"""Operators on ballots: styles, tallies, summaries, balancing, release, inference, exploration."""
