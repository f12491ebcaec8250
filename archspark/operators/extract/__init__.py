"""Fact extraction: files to nodes, edges, references and schema tables."""

from archspark.operators.extract.facts import Extraction, extract_all, register_extractor

__all__ = ["Extraction", "extract_all", "register_extractor"]
