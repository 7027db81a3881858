"""The driver tables as ratings, registered queries, and their SQL."""
