"""The registered queries: test tables in the roles of fleet tables."""
