"""The registered queries, the SQL they are checked against, and their input tables."""
