"""Lumenbox: screen-grounding analytics as DataFrame and Column operations."""
