"""Operators over the tables of a collection: k-mers, segmentation, grouping, catalog queries, codec and archive."""
