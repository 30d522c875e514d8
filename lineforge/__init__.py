"""Spare-parts order-line analytics expressed as PySpark DataFrame operators."""
