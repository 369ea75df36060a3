"""Kvasir: graph, spatial and corpus analytics expressed as Spark plans."""
