"""Plans of loomspan."""
