"""Algebra over tables: the compiler, and operations on tables of trees."""
