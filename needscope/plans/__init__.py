"""Table builds that compose the operators."""
