"""Readers for the published files and the tables kept between runs."""
