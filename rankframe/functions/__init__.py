"""Scalar building blocks: columns from columns."""
