"""Diligence analytics and training-corpus operators expressed as Spark plans."""
