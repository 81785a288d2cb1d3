"""Registered queries over the star-schema test tables, with their SQL oracles."""
