"""Whole jobs put together from sources, functions and operators."""
