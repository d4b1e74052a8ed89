"""Columns from columns."""
