"""Operators of loomspan."""
