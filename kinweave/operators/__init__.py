"""Operators on feature tables, links, graphs and assignments."""
