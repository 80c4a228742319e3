"""Point-in-time research analytics as PySpark DataFrame functions."""
