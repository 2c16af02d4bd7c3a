"""Operators on tables of rooms, materials, markups and projects."""
