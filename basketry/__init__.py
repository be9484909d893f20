"""Basket-style co-occurrence analytics on Spark: operators, sources, functions, plans and streams."""
