"""Streaming of loomspan."""
