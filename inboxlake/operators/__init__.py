"""Inbox operators: DataFrames in, DataFrame out; nothing is collected."""
