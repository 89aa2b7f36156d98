"""Registered queries of the core, by topic; each module has QUERIES and ORACLES."""
