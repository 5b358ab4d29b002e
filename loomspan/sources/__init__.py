"""Sources of loomspan."""
