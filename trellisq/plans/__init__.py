"""Registered queries: a plan over the stored tables and its SQL twin."""
