"""Diagnosis of Spark applications from their event logs, as Spark jobs over a whole corpus of logs."""
