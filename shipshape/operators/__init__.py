"""Analytical operators over the star schema; every function returns a lazy DataFrame."""
