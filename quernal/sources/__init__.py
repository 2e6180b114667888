"""Where chunks come from: file trees, git, tables."""
