"""Reading and writing raw CSV and JSON."""
