"""DataFrame -> DataFrame operators: joins, aggregates, paging, mutations, audit."""
