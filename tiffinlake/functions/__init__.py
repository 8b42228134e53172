"""Column-level building blocks: casts, business rules, lookups and keys."""
