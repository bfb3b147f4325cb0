"""Vellum: document analytics expressed as Spark DataFrame programs."""
