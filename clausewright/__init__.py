"""Regulatory-text analytics on PySpark: segmentation, chunking, graphs, classification, curation and scoring."""
