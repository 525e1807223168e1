"""DataFrame to DataFrame operators, each over all storms or all cells at once."""
