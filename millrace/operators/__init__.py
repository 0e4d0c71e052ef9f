"""DataFrame operators: counting, lookup joins, nesting, pair sampling, sorting, and user-defined map and reduce."""
