"""Column -> Column functions and the SQL function registry."""
