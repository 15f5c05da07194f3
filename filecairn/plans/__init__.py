"""Plan shapes shared by the operators: skewed joins, ordering, cut points."""
