"""Jobs and views, composed from the operators."""
