"""Where rows come from and go to: versioned tables, statement logs, binary pages."""
