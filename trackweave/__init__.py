"""Fusing, alerting on and analysing observation streams with Spark."""
