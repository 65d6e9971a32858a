"""Operators of a training-data pipeline: ten numbered ones, their queries and the SQL that checks them."""
