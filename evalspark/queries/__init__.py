"""Registered queries: each operator over the given tables, with DuckDB SQL beside it."""
