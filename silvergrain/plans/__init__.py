"""Registered queries, each with an independent SQL oracle where SQL can state it."""
