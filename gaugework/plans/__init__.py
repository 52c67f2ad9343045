"""Runnable queries over the shared test tables, each with its reference SQL where it has one."""
