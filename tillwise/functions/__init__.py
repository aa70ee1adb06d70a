"""Column-level building blocks: fixed values, date handling, numbers, labels."""
