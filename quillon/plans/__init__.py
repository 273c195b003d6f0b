"""Statistics of tables, and how many files they need."""
