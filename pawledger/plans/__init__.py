"""Whole dashboards composed from operators."""
