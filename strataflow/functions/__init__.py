"""Scalar rules and term mapping."""
