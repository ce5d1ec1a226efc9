"""Cellstrata: spatial-omics and corpus analytics as Spark DataFrame operators."""
