"""Vellum: Spark-native curation and analytics of clinical-style records and text corpora."""
