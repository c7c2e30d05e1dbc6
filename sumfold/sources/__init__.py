"""File formats read and written."""
