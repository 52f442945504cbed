"""Registered queries: compositions of operators over the test tables, each beside its DuckDB SQL."""
