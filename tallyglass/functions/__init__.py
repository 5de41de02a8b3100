"""Column-level helpers: fixed values, text rules, time buckets and type families."""
