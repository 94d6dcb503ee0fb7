"""Multi-stage query plans and the registry of named queries."""
