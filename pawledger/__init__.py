"""Clinic and retail KPI reports as Spark DataFrame operators."""
