"""Turns semi-structured documents into validated records with Spark plans."""
