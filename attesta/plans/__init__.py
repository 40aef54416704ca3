"""Input views over the shared tables and the registered queries."""
