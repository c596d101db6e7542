"""Relational, graph and text operators over fact tables."""
