"""Operators over tables: scans, changes of rows, and rows by position."""
