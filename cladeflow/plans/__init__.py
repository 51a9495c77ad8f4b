"""Registered queries: operators applied to the driver's tables, with the SQL that they must equal."""
