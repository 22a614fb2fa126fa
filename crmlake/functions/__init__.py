"""Column -> Column scalar functions and predicate builders."""
