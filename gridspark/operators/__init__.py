"""Table operators: row order and frames, lookups, criteria, dynamic arrays, components."""
