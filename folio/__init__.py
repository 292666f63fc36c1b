"""Folio: PDF files as queryable tables, on Spark."""
