"""Functions of loomspan."""
