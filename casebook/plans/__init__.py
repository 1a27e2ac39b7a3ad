"""Registered queries and the views over the driver tables that they start from."""
