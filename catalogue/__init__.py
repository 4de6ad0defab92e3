"""Registered queries over the test tables; see ``registered``."""
