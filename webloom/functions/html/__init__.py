"""HTML pages: a tolerant tree, selectors, Markdown, metadata and articles."""
