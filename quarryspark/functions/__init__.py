"""Modules of this folder hold plain functions over DataFrames and columns."""
