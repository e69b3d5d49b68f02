"""Column functions: no DataFrame, no job, no Python worker."""
