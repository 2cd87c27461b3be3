"""Layered e-commerce warehouse on Spark: ingest, validate, model and check order data."""
