"""Shared plan shapes: size checks, one-row joins, exact quantiles, ordered passes, value counts."""
