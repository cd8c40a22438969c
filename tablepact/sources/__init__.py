"""Where rows come from: declared reads, CSV files and in-memory tables."""
