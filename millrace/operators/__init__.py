"""DataFrame operators: joins, windows, change capture, schema, layout, corpora."""
