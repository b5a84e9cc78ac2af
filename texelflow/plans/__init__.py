"""Registered queries: relations derived from the driver's tables, with their SQL."""
