"""Ontologies and mappings made from schemas, and their alignment with reference vocabularies."""
