"""Table definitions, checks, serving queries and the runner."""
