"""Reports of a scan: text, JSON and HTML for people, tables for programs."""
