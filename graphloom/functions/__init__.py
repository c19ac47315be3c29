"""Terms, scalar functions, geometry and geodesy."""
