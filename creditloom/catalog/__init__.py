"""Registered queries and the SQL that each must agree with."""
