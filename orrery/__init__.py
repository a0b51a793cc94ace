"""Orrery: a Spark-first engine for relational NLP, fact rules and retrieval."""
