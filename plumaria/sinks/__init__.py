"""Writers of Markdown notes."""
