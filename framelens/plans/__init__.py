"""Registered queries over whole tables and their equivalent SQL."""
