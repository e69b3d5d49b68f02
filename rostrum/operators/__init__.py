"""DataFrame operators of the speech table."""
