"""Demand and inventory analytics for marketplace order lines, written as Spark jobs."""
