"""Scalar expressions over log fields."""
