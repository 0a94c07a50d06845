"""Indel repair-mechanism analytics expressed as Spark DataFrame operators."""
