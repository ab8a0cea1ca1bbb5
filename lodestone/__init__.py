"""Lodestone: corpus, graph and vector analytics as ordinary Spark DataFrame queries."""
