"""Runtime of loomspan."""
