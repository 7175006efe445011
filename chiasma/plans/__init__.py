"""Whole workflows, the driver's queries and their SQL."""
