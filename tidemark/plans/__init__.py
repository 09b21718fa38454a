"""Operators composed to queries over the star-schema tables, each with its DuckDB SQL."""
