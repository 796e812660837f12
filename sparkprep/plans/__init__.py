"""Cleaning plans: enumeration, scoring, selection, application."""
