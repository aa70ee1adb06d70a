"""Sub-plans shared by several operators."""
