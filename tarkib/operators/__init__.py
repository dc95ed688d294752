"""Transforms of DataFrames: lookups, votes, sets, sequences, pairs, layout, scores, ensembles, engines."""
