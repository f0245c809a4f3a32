"""Tessera: program-facts analytics as Spark plans."""
