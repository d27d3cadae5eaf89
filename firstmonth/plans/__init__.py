"""Whole runs: from raw tables to the cleaned first month and its reports."""
