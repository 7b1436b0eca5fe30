"""DataFrame operators over pages, lines, sections and nodes."""
