"""Operators on daily cells, records, facts and drafts."""
