"""Operators over keyed counts, lines, graphs and records; each takes and returns DataFrames and collects nothing."""
