"""Readers that turn folders of scripts into DataFrames, and report writers."""
