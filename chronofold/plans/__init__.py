"""Whole plans: picking, classification, summary, collection, export."""
