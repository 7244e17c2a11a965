"""Canonical tables derived from the driver's TPC-H-like tables, and their SQL twins."""
