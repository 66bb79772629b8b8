"""Queries made of the operators, with the SQL they are held against."""
