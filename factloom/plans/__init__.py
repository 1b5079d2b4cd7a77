"""Projections of the driver's tables and the query registry built on them."""
