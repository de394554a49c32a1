"""Expression, predicate, accumulator and update compilers."""
