"""Mediated data integration, approximate key matching and rule-based cleansing on Spark."""
