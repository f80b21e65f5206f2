"""Registered queries over the driver tables, their input adapters and their SQL equivalents."""
