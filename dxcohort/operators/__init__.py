"""Reusable DataFrame operators (no session state, no actions except where a
size bound is checked)."""
