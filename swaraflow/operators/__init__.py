"""Table-level operators: gates, voices, routing, lookups, mixtures, metrics, panels."""
