"""Relational operators on long tables.

counts(cell_id, gene, value) has no zeros, so whatever counts, averages or takes
medians starts from the axis tables. ``signal`` tables are long: cell_id,
gene_ix, value; ``cn`` and ``dev`` tables: cell_id, segment_id, value.
"""
