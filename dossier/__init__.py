"""Tender, proposal and feedback analytics as Spark DataFrame jobs."""
