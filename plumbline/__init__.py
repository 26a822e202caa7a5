"""plumbline: declared expectations checked, explained and repaired on Spark tables and streams."""
