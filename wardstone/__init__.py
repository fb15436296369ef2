"""Wardstone: permission-aware document retrieval and its bookkeeping as Spark DataFrame jobs."""
