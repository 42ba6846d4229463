"""Spark jobs over login exports, opportunity amounts, text files and file inventories."""
