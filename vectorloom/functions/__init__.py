"""Column functions: vectors and portable pseudo-random numbers."""
