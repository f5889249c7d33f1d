"""DataFrame operators on interval, coverage, group and signal tables."""
