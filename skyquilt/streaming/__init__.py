"""Forecasts scored as they arrive."""
