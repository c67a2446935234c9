"""Tessella: structural evidence and corpus preparation as Spark DataFrame operators."""
