"""Readers and writers: claims tables, code lists and the code dimension, and
the test fixture derived from the TPC-H-like test tables."""
