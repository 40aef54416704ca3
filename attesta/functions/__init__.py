"""Column builders: every function takes Columns and returns a Column."""
