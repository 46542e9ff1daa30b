"""Registered queries over whole tables, with SQL to hold them against."""
