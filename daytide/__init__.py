"""User-day behaviour analytics as lazy PySpark DataFrame functions."""
