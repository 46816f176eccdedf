"""Queries on the tables, with the SQL that checks them."""
