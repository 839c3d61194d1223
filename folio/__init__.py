"""Catalog analytics and text preparation as lazy DataFrame operators."""
