"""The passes over data: melting, counting values, profiling, combining parts, relating, ordering."""
